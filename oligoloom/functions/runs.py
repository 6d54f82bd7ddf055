"""Longest common run of two equally long strings.

A run is a stretch where ``a[i] == partner[i + offset]``; it counts when its last base lies
in the last ``window`` positions of ``a`` (window = length: anywhere). All offsets are walked for a block of pairs at a
time: a step compares one position of every pair in a single byte operation, so a pair takes a fraction of a microsecond,
whatever its bases are. Of the longest runs that with the smallest offset, then the smallest start, is taken. The
melting temperature of the run is worked out on the same arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oligoloom.functions.melting import Chemistry, run_tm
from oligoloom.functions.staging import stage

# Pairs that are walked together: few enough for their bases to stay in a processor's cache.
BLOCK = 16_384
_FOUND = "length int, start int, offset int, tm double"


def _bases(texts: pa.Array, length: int, absent: int) -> np.ndarray:
    """The bytes of the texts, a row for each position; ``absent`` stands where a text (or null) has no base."""
    n = len(texts)
    if not n:
        return np.empty((length, 0), np.uint8)
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    text = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    if not texts.null_count and (np.diff(ends) == length).all():
        return np.ascontiguousarray(text[ends[0] : ends[-1]].reshape(n, length).T)
    sizes = np.where(np.asarray(texts.is_valid()), np.diff(ends), 0)
    out = np.full((length, n), absent, np.uint8)
    for place in range(length):
        there = np.flatnonzero(sizes > place)
        out[place, there] = text[ends[there] + place]
    return out


def _longest(a: np.ndarray, partner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length, start and offset of the best run of every pair (length 0: none)."""
    length, n = a.shape
    first = max(0, length - max(1, window))
    kind = np.uint8 if length < 256 else np.uint32
    best, offset = np.zeros(n, kind), np.zeros(n, np.int32)
    run, top, same = np.empty(n, kind), np.empty(n, kind), np.empty(n, bool)
    for shift in range(1 - length, length - first):
        run[:], top[:] = 0, 0
        for i in range(max(0, -shift), min(length, length - shift)):
            np.equal(a[i], partner[i + shift], out=same)
            run += 1
            run *= same
            if i >= first:
                np.maximum(top, run, out=top)
        np.greater(top, best, out=same)
        np.maximum(best, top, out=best)
        np.copyto(offset, shift, where=same)

    # Where on its offset the run starts: the smallest place from which that many bases agree, ending in the window.
    start, size = np.zeros(n, np.int32), best.astype(np.int32)
    around = np.zeros((3 * length, n), np.uint8)
    around[length : 2 * length] = partner
    around, row = around.ravel(), (length + offset.astype(np.int64)) * n + np.arange(n)
    run[:] = 0
    for i in range(length - 1, -1, -1):
        np.equal(a[i], around[row + i * n], out=same)
        run += 1
        run *= same
        np.copyto(start, i, where=(run >= best) & (size > max(0, first - i)))
    return size, start, offset


def _found_in(
    length: int, window: int, active: int, chemistry: Chemistry | None
) -> Callable[[pa.Array, pa.Array], pa.Array]:
    def blocks(a: pa.Array, partner: pa.Array) -> Iterator[pa.Array]:
        for begin in range(0, len(a), BLOCK):
            ours = _bases(a.slice(begin, BLOCK), length, 1)
            size, start, offset = _longest(ours, _bases(partner.slice(begin, BLOCK), length, 2), window)
            tm = np.full(len(size), -np.inf)
            if chemistry is not None:
                warm = np.flatnonzero(size >= active)
                tm[warm] = run_tm(ours[:, warm], start[warm], size[warm], chemistry)
            columns = [pa.array(size), pa.array(start), pa.array(offset, mask=size == 0), pa.array(tm)]
            yield pa.StructArray.from_arrays(columns, ["length", "start", "offset", "tm"])

    def found(a: pa.Array, partner: pa.Array) -> pa.Array:
        done = list(blocks(a, partner))
        kinds = [("length", pa.int32()), ("start", pa.int32()), ("offset", pa.int32()), ("tm", pa.float64())]
        return pa.concat_arrays(done) if done else pa.array([], pa.struct(kinds))

    return found


def found_run(
    a: str, partner: str, length: int, window: int, active: int = 1, chemistry: Chemistry | None = None
) -> Column:
    """Best run of two columns as a record: length, start, offset (null: no common base) and, with ``chemistry``,
    the melting temperature of a run of at least ``active`` bases (else -inf). ``stage`` it before use."""
    return F.arrow_udf(_found_in(length, window, active, chemistry), _FOUND)(F.col(a), F.col(partner))


def hot_run_ends(
    a: str,
    partner: str,
    a_last: str,
    partner_last: str,
    length: int,
    window: int,
    active: int,
    chemistry: Chemistry,
    limit_c: float,
) -> Column:
    """Whether the best run of two columns ends at the given positions and melts above the limit. One truth value comes
    back for a pair, so this is cheaper than its record where no more than the pair is wanted."""
    record = _found_in(length, window, active, chemistry)

    def ends(a: pa.Array, partner: pa.Array, a_last: pa.Array, partner_last: pa.Array) -> pa.Array:
        size, start, offset, tm = record(a, partner).flatten()
        size, tm = size.to_numpy(), tm.to_numpy()
        last = start.to_numpy() + size - 1
        there = (last == a_last.to_numpy()) & (last + offset.fill_null(0).to_numpy() == partner_last.to_numpy())
        return pa.array((size > 0) & there & (tm > limit_c))

    return F.arrow_udf(ends, "boolean")(F.col(a), F.col(partner), F.col(a_last), F.col(partner_last))


def best_meetings(
    met: DataFrame,
    a: str,
    partner: str,
    a_last: str,
    partner_last: str,
    length: int,
    window: int,
    out: str,
    active: int = 1,
    chemistry: Chemistry | None = None,
) -> DataFrame:
    """Of meetings (ends of a common run) those that no admissible run is longer than, with the length of their run.

    ``<out>_found`` is the record of the pair's best run, see ``found_run``.
    """
    rows = stage(met, {f"{out}_found": found_run(a, partner, length, window, active, chemistry)})
    rows = rows.withColumn(out, F.col(f"{out}_found.length"))
    words = [f"substring({seq}, {last} + 2 - {out}, {out})" for seq, last in ((a, a_last), (partner, partner_last))]
    return rows.where(f"{out} > 0 and {out} <= least({a_last}, {partner_last}) + 1 and {words[0]} = {words[1]}")


def with_best_run(
    pairs: DataFrame,
    a: str,
    partner: str,
    length: int,
    window: int,
    prefix: str = "run",
    found: str | None = None,
) -> DataFrame:
    """Add ``<prefix>_length``, ``<prefix>_start`` and ``<prefix>_offset`` (0-based).

    Without any common base the length is 0, start is 0 and the offset is null. ``found`` names a column that
    already holds the record of the best run.
    """
    record = found or "__found"
    if found is None:
        pairs = stage(pairs, {record: found_run(a, partner, length, window)})
    names = ("length", "start", "offset")
    return pairs.withColumns({f"{prefix}_{name}": F.col(f"{record}.{name}") for name in names}).drop("__found")


def with_score(
    pairs: DataFrame,
    a: str,
    partner: str,
    length: int,
    window: int,
    min_run: int,
    gate: int,
    chemistry: Chemistry,
    prefix: str = "run",
    found: str | None = None,
) -> DataFrame:
    """Best run plus its score record; ``found`` names a column that already holds the record of the best run.

    The melting temperature is only worked out for runs that reach both the minimum run and
    the precomputed gate; shorter ones get -inf and say why.
    """
    active = max(min_run, gate)
    record = found or "__scored"
    if found is None:
        pairs = stage(pairs, {record: found_run(a, partner, length, window, active, chemistry)})
    out = with_best_run(pairs, a, partner, length, window, prefix, record)
    size = F.col(f"{prefix}_length")
    columns = {
        f"{prefix}_sequence": F.substring(F.col(a), F.col(f"{prefix}_start") + 1, size),
        f"{prefix}_tm_c": F.col(f"{record}.tm"),
        f"{prefix}_below_min": size < min_run,
        f"{prefix}_shortcircuited": (size >= min_run) & (size < active),
        f"{prefix}_evaluated": size >= active,
    }
    return out.withColumns(columns).drop(record)
