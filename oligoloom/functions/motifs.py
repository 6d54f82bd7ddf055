"""Per-sequence rejection predicates (true means reject)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from oligoloom.functions.sequence import MAX_PACKED


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def _has_run(marks: Column, run: int) -> Column:
    """Are there ``run`` neighbouring two-bit digits whose low bit is set?"""
    covered = 1
    while covered < run:
        step = min(covered, run - covered)
        marks = marks.bitwiseAND(F.shiftright(marks, 2 * step))
        covered += step
    return marks != 0


def tandem_repeat(seq: Column, length: int, unit: int, copies: int, packed: Column | None = None) -> Column:
    """Does some unit of ``unit`` bases occur ``copies`` times in a row?

    That is the same as ``unit * (copies - 1)`` neighbouring positions that each equal the
    position ``unit`` further on, which on a packed sequence is one shift and one XOR.
    """
    if unit * copies > length:
        return F.lit(False)
    if packed is None or length > MAX_PACKED:
        return seq.rlike(rf"(.{{{unit}}})\1{{{copies - 1}}}")
    ones = sum(1 << (2 * i) for i in range(length - unit))
    differ = packed.bitwiseXOR(F.shiftright(packed, 2 * unit))
    differ = differ.bitwiseOR(F.shiftright(differ, 1)).bitwiseAND(F.lit(ones))
    return _has_run(differ.bitwiseXOR(F.lit(ones)), unit * (copies - 1))


def homopolymer_exceeds(seq: Column, length: int, limit: int, packed: Column | None = None) -> Column:
    return tandem_repeat(seq, length, 1, limit + 1, packed)


def repeat_exceeds(seq: Column, length: int, unit: int, limit: int, packed: Column | None = None) -> Column:
    """Unit repeated more than ``limit`` times; a limit of zero or less switches it off."""
    if unit <= 0 or limit <= 0:
        return F.lit(False)
    return tandem_repeat(seq, length, unit, limit + 1, packed)


def both_strands(motifs: Iterable[str]) -> tuple[str, ...]:
    """The motifs and their reverse complements, each once."""
    opposite = str.maketrans("ACGT", "TGCA")
    return tuple(sorted({word for motif in motifs for word in (motif, motif.translate(opposite)[::-1])}))


def contains_motif(seq: Column, motifs: tuple[str, ...]) -> Column:
    return _any([F.contains(seq, F.lit(m)) for m in motifs if m])


def self_stem(seq: str, rc: str, length: int, stem: int, gap: int) -> Column:
    """Can the sequence pair with itself over ``stem`` bases?

    The two arms are a word at ``i`` and its reverse complement at ``q``. Base pairs whose
    partners are ``gap`` or fewer positions apart do not count and interrupt a stem. Arms are
    interchangeable, so only q >= i is looked at:

    * arms apart, q >= i + stem + gap: one ``locate`` from there on finds any of them;
    * arms overlapping: the stem passes through its own centre and survives only when no
      pair is excluded there, i.e. gap 0 and an even number of bases in total.
    """
    if stem <= 0:
        return F.lit(False)

    def arm(i: int) -> str:
        return f"substring({rc}, {length - i - stem + 1}, {stem})"

    conditions = [
        f"locate({arm(i)}, {seq}, {i + stem + gap + 1}) > 0" for i in range(length - 2 * stem - gap + 1)
    ]
    if gap == 0:
        conditions += [
            f"substring({seq}, {q + 1}, {stem}) = {arm(i)}"
            for i in range(length - stem + 1)
            for q in range(i, min(i + stem, length - stem + 1))
            if (q - i - stem) % 2 == 0
        ]
    return F.expr(" or ".join(conditions) or "false")


def longest_self_run(packed: str, packed_rc: str, length: int, gap: int) -> Column:
    """The longest stem of ``self_stem``, from the packed sequence and its packed reverse complement.

    On each diagonal the bases that match are marked, one bit in two, in a LONG. Marks of runs of 1, 2, 4, ... bases
    follow from one another by a shift and an AND on all diagonals at once; bisection over these powers then puts the
    longest run of any diagonal together.
    """
    if length > MAX_PACKED:
        raise ValueError(f"at most {MAX_PACKED} bases are packed")
    last, marks = length - 1, []
    for offset in range(-last, length):
        rows = range(max(0, -offset), min(length, length - offset))
        mask = sum(1 << (2 * (last - i)) for i in rows if abs(last - offset - 2 * i) > gap)
        low = (1 << (2 * (length - abs(offset)))) - 1
        moved = f"shiftleft({packed_rc} & {low}L, {2 * offset})" if offset >= 0 else f"shiftright({packed_rc}, {-2 * offset})"
        differ = f"({packed} ^ {moved})"
        marks.append(f"(~({differ} | shiftright({differ}, 1)) & {mask}L)")
    powers = [f"array({', '.join(marks)})"]
    while 2 ** len(powers) <= length:
        run = 2 ** len(powers)
        powers.append(f"transform(p{len(powers) - 1}, m -> m & shiftright(m, {run}))")
    # let(name, value, body) as a one-element array, so that every step is worked out once.
    body = "state.size"
    for k in range(len(powers)):
        grown = f"zip_with(state.runs, p{k}, (r, m) -> if(state.size = 0, m, r & shiftright(m, 2 * state.size)))"
        tried = f"transform(array({grown}), g -> if(exists(g, x -> x != 0), struct(state.size + {2**k} as size, g as runs), state))[0]"
        body = f"transform(array({tried}), state -> {body})[0]"
    body = f"transform(array(struct(0 as size, p0 as runs)), state -> {body})[0]"
    for k in reversed(range(len(powers))):
        body = f"transform(array({powers[k]}), p{k} -> {body})[0]"
    return F.expr(body)


def self_complementary(seq: str, rc: str, length: int, threshold: int) -> Column:
    return self_stem(seq, rc, length, threshold, gap=2)


def near_palindrome(seq: str, rc: str, length: int, min_match: int) -> Column:
    return self_stem(seq, rc, length, min_match, gap=0)
