"""Cross-hybridisation conflicts between the oligos of a pool.

For left < right only ``left`` against the reverse complement of ``right`` counts, so the
relation depends on acceptance order. A pair conflicts when the melting temperature of its
best run exceeds a limit.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oligoloom.functions.melting import KELVIN, NEIGHBOUR_PARAMETERS, TERMINAL_AT, TERMINAL_GC, Chemistry
from oligoloom.functions.runs import best_meetings, found_run, hot_run_ends, with_score
from oligoloom.functions.staging import keep, stage
from oligoloom.functions.sequence import ALPHABET, MAX_PACKED, kmers, pack, reverse_complement, three_prime_starts, words_sql
from oligoloom.operators.skew import CELL_MATCHES, grid_join, spread


@dataclass(frozen=True)
class PairRules:
    """How two oligos are scored against each other."""

    length: int
    limit_c: float = 40.0
    window: int = 3
    min_run: int = 4
    gate: int = 0
    chemistry: Chemistry = field(default_factory=Chemistry)

    def __post_init__(self) -> None:
        if self.min_run < 1:
            raise ValueError("the minimum run must be at least 1")

    @property
    def active_run(self) -> int:
        """Shortest run whose melting temperature is evaluated."""
        return max(self.min_run, self.gate)

    def anywhere(self, limit_c: float | None = None, gate: int | None = None) -> "PairRules":
        """The same rules for runs at any position (sense against sense)."""
        return replace(
            self,
            window=self.length,
            limit_c=self.limit_c if limit_c is None else limit_c,
            gate=self.gate if gate is None else gate,
        )


# Hot-text costs are integers, this many per cal/mol, so that sums are exact in any context.
COST_SCALE = 1000


def _cost(values: tuple[float, float], kelvin: float) -> int:
    """Scaled 1000 dH - T dS, rounded down."""
    return math.floor(COST_SCALE * (1000 * values[0] - kelvin * values[1]))


def with_shortest_hot_suffix(rows: DataFrame, seq: str, lasts: range, rules: PairRules) -> DataFrame:
    """Explode a sequence into one join key per end position.

    A text is hot when it reaches the active run length and melts above the limit. The key at
    position ``last`` is the shortest hot text that ends there; positions without one drop out.
    If two sequences share any hot run, the shortest hot suffix of that run is the same text
    on both sides, so they share a key at the run's end. One key per position therefore finds
    every conflict, and a pair only meets if it really shares a text that melts too high.

    Entropies being negative, "melts above T" means that 1000 dH - T dS, a sum over the text,
    is negative. Rounding the summands down to integers can only make a text count as hot that
    is not quite; the exact temperature is checked on the pairs.

    Keys are LONGs: the packed text behind a leading 1 bit. Beyond 31 bases, where packing
    ends, the plain 31-base suffix stands in for a longer hot text.
    """
    kept = rows.columns
    n, reach = rules.length, min(rules.length, MAX_PACKED)
    kelvin = rules.limit_c + KELVIN
    selective = kelvin > 0
    lasts = [last for last in lasts if last + 1 >= min(rules.active_run, reach)]

    # Base codes from the 5' end, read off packed blocks.
    codes = []
    for begin in range(0, n, MAX_PACKED):
        size = min(MAX_PACKED, n - begin)
        rows = rows.withColumn(f"__block{begin}", pack(F.substring(seq, begin + 1, size)))
        codes += [f"int(shiftright(__block{begin}, {2 * (size - 1 - p)}) & 3)" for p in range(size)]
    rows = rows.withColumn("__codes", F.expr(f"array({', '.join(codes)})"))
    if selective:
        pairs = ", ".join(f"{_cost(NEIGHBOUR_PARAMETERS[a + b], kelvin)}L" for a in ALPHABET for b in ALPHABET)
        ends = ", ".join(f"{_cost(TERMINAL_AT if b in 'AT' else TERMINAL_GC, kelvin)}L" for b in ALPHABET)
        steps = [f"get(array({pairs}), get(__codes, {p}) * 4 + get(__codes, {p + 1}))" for p in range(n - 1)]
        rows = rows.withColumn("__steps", F.expr(f"cast(array({', '.join(steps)}) as array<bigint>)"))
        sums = F.expr("aggregate(__steps, array(0L), (sums, step) -> concat(sums, array(element_at(sums, -1) + step)))")
        rows = rows.withColumn("__sums", sums)
        rows = rows.withColumn("__ends", F.expr(f"transform(__codes, c -> get(array({ends}), c))"))
        rows = rows.withColumn("__starts", F.expr("zip_with(__sums, __ends, (s, e) -> s - e)"))
    rows = rows.withColumn("last", F.explode(F.array(*[F.lit(p) for p in lasts]).cast("array<int>")))
    if selective:
        rows = rows.withColumn("__at_last", F.expr("get(__sums, last) + get(__ends, last)"))

    choices = []
    for length in range(rules.active_run, reach + 1):
        if selective:
            chemistry = rules.chemistry
            rest = _cost((0.0, chemistry.salt_entropy * (length - 1) + chemistry.strand_entropy), kelvin)
            # get() is null before the first base, which counts as no.
            choices.append(f"when get(__starts, last - {length - 1}) > __at_last + {rest}L then {length}")
        else:
            choices.append(f"when last >= {length - 1} then {length}")
    if n > MAX_PACKED:
        choices.append(f"when last + 1 >= {MAX_PACKED} then {MAX_PACKED}")
    size = F.expr(f"case {' '.join(choices)} end" if choices else "int(null)")
    rows = rows.withColumn("__size", size)
    if n <= MAX_PACKED:
        tail = F.expr(f"shiftright(__block0, ({n - 1} - last) * 2)")
    else:
        tail = pack(F.expr(f"substring({seq}, last + 2 - __size, __size)"))
    rows = rows.withColumn("__tail", tail)
    key = F.expr("shiftleft(1L, 2 * __size) | (__tail & (shiftleft(1L, 2 * __size) - 1L))")
    columns = {name: F.col(name) for name in [*kept, "last"]}
    return keep(rows, F.col("__size").isNotNull(), {**columns, "key": key})


def _base(pool: DataFrame, seq: str, order: str) -> DataFrame:
    return spread(pool.select(F.col(order).alias("__id"), F.col(seq).alias("__seq")), "__id", pool.count())


def left_keys(pool: DataFrame, rules: PairRules, seq: str = "sequence", order: str = "idx") -> DataFrame:
    """(key, left_index, left_sequence, left_last) of every end position in the window that has a key."""
    window = range(max(0, rules.length - max(1, rules.window)), rules.length)
    keys = with_shortest_hot_suffix(_base(pool, seq, order), "__seq", window, rules)
    return keys.select(
        "key",
        F.col("__id").alias("left_index"),
        F.col("__seq").alias("left_sequence"),
        F.col("last").alias("left_last"),
    )


def right_keys(
    pool: DataFrame, rules: PairRules, seq: str = "sequence", order: str = "idx", sense: bool = False
) -> DataFrame:
    """(key, right_index, partner, right_last) of all end positions of what the left oligo is compared with."""
    partner = F.col("__seq") if sense else reverse_complement(F.col("__seq"))
    rows = _base(pool, seq, order).withColumn("__partner", partner)
    return with_shortest_hot_suffix(rows, "__partner", range(rules.length), rules).select(
        "key",
        F.col("__id").alias("right_index"),
        F.col("__partner").alias("partner"),
        F.col("last").alias("right_last"),
    )


def _meetings(left: DataFrame, right: DataFrame, rules: PairRules, ordered: bool, cell_matches: int) -> DataFrame:
    """Pairs that share a key at the end of a common run."""
    n = rules.length
    met = F.col("left_index") < F.col("right_index") if ordered else F.col("left_index") != F.col("right_index")
    # A best run ends where the texts part, so meetings inside a longer run are no candidates.
    met = met & F.expr(
        f"(left_last = {n - 1} or right_last = {n - 1}"
        " or substring(left_sequence, left_last + 2, 1) != substring(partner, right_last + 2, 1))"
    )
    return grid_join(left, right, "key", "left_index", "right_index", met, cell_matches)


_ENDS = ("left_sequence", "partner", "left_last", "right_last")


def _scored(left: DataFrame, right: DataFrame, rules: PairRules, ordered: bool, cell_matches: int) -> DataFrame:
    n, active, chemistry = rules.length, rules.active_run, rules.chemistry
    pairs = _meetings(left, right, rules, ordered, cell_matches)
    pairs = best_meetings(pairs, *_ENDS, n, rules.window, "__run", active, chemistry)
    scored = with_score(
        pairs, "left_sequence", "partner", n, rules.window, rules.min_run, rules.gate, chemistry, found="__run_found"
    )
    # A pair can meet at several positions but has one best run: keep the meeting at its end.
    # That replaces a distinct over all pairs, and checks that the best run is the hot one.
    run_end = F.col("run_start") + F.col("run_length") - 1
    return scored.where(
        (run_end == F.col("left_last"))
        & (run_end + F.col("run_offset") == F.col("right_last"))
        & (F.col("run_tm_c") > rules.limit_c)
    )


def conflicts_of_keys(
    left: DataFrame, right: DataFrame, rules: PairRules, cell_matches: int = CELL_MATCHES
) -> DataFrame:
    """Conflicting pairs, left before right, of ``left_keys`` and ``right_keys``."""
    return _scored(left, right, rules, True, cell_matches).select(
        "left_index",
        "right_index",
        "left_sequence",
        reverse_complement(F.col("partner")).alias("right_sequence"),
        "run_length",
        "run_sequence",
        F.col("run_tm_c").alias("tm_c"),
    )


def conflict_edges(
    pool: DataFrame,
    rules: PairRules,
    seq: str = "sequence",
    order: str = "idx",
    first_new: int | None = None,
    cell_matches: int = CELL_MATCHES,
) -> DataFrame:
    """Conflicting pairs, left before right; with ``first_new`` only those with a new member.

    ``pool`` is read several times, so pass a table (see ``storage.materialize``).
    """
    newer = pool if first_new is None else pool.where(F.col(order) >= first_new)
    return conflicts_of_keys(
        left_keys(pool, rules, seq, order), right_keys(newer, rules, seq, order), rules, cell_matches
    )


def conflict_pairs(
    pool: DataFrame, rules: PairRules, seq: str = "sequence", order: str = "idx", cell_matches: int = CELL_MATCHES
) -> DataFrame:
    """(left_index, right_index) of the rows of ``conflict_edges``: as each pair meets once at the end of its best run,
    a test of the meetings is all that is needed, and neither texts nor records are carried on."""
    keys = left_keys(pool, rules, seq, order), right_keys(pool, rules, seq, order)
    met = _meetings(*keys, rules, True, cell_matches)
    hot = hot_run_ends(*_ENDS, rules.length, rules.window, rules.active_run, rules.chemistry, rules.limit_c)
    return met.where(hot).select("left_index", "right_index")


def sense_conflicts(
    pool: DataFrame,
    rules: PairRules,
    seq: str = "sequence",
    order: str = "idx",
    cell_matches: int = CELL_MATCHES,
) -> DataFrame:
    """Directed pairs whose sense score exceeds the limit (both directions are listed)."""
    sense = rules.anywhere()
    keys = left_keys(pool, sense, seq, order), right_keys(pool, sense, seq, order, sense=True)
    hits = _scored(*keys, sense, False, cell_matches)
    return hits.select(
        "left_index",
        "right_index",
        "left_sequence",
        F.col("partner").alias("right_sequence"),
        "run_length",
        "run_sequence",
        F.col("run_tm_c").alias("tm_c"),
    )


def candidate_pairs(
    pool: DataFrame,
    k: int,
    rules: PairRules,
    seq: str = "sequence",
    order: str = "idx",
    first_new: int | None = None,
    cell_matches: int = CELL_MATCHES,
) -> DataFrame:
    """Pairs whose best anchored run reaches ``k``: a k-mer equi-join.

    Of several shared k-mers only the first anchored one reports the pair, which is checked in
    the row itself and saves a distinct over the joined pairs. Counting alone does not need
    this join, see ``pair_counts``.
    """
    n = rules.length
    starts, count = three_prime_starts(n, k, rules.window), pool.count()
    base = spread(pool.select(F.col(order).alias("__id"), F.col(seq).alias("__seq")), "__id", count)
    words = F.expr(words_sql("__seq", k, starts))
    left = base.select(
        F.col("__id").alias("left_index"),
        F.col("__seq").alias("left_sequence"),
        F.posexplode(words).alias("nth", "word"),
    )
    newer = base if first_new is None else base.where(F.col("__id") >= first_new)
    right = (
        newer.select(F.col("__id").alias("right_index"), reverse_complement(F.col("__seq")).alias("partner"))
        .withColumn("word", F.explode(kmers("partner", k, n)))
    )
    condition = F.col("left_index") < F.col("right_index")
    for nth, start in enumerate(starts[:-1]):
        earlier = F.contains(F.col("partner"), F.substring("left_sequence", start + 1, k))
        condition = condition & ((F.col("nth") <= nth) | ~earlier)
    pairs = grid_join(left, right, "word", "left_index", "right_index", condition, cell_matches)
    return pairs.select("left_index", "right_index", "left_sequence", "partner")


def score_pairs(pairs: DataFrame, rules: PairRules) -> DataFrame:
    """Score record of given pairs (``left_sequence`` against ``partner``)."""
    return with_score(
        pairs,
        "left_sequence",
        "partner",
        rules.length,
        rules.window,
        rules.min_run,
        rules.gate,
        rules.chemistry,
    )


def sense_pair_scores(pairs: DataFrame, rules: PairRules) -> DataFrame:
    """Both sense directions of given pairs and the higher of the two temperatures."""
    n = rules.length
    ends = ("left_sequence", "right_sequence")
    ways = {"fwd": ends, "rev": ends[::-1]}
    found = {f"__{way}": found_run(*texts, n, n, rules.active_run, rules.chemistry) for way, texts in ways.items()}
    # One step finds both.
    out = stage(pairs, found)
    for way, texts in ways.items():
        out = with_score(
            out, *texts, n, n, rules.min_run, rules.gate, rules.chemistry, prefix=way, found=f"__{way}"
        )
    return out.withColumn("pair_tm_c", F.greatest("fwd_tm_c", "rev_tm_c"))


def conflict_degrees(edges: DataFrame) -> DataFrame:
    ends = F.array("left_index", "right_index")
    return edges.select(F.explode(ends).alias("idx")).groupBy("idx").agg(F.count(F.lit(1)).alias("degree"))


