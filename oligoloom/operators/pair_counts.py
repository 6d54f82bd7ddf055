"""How many pairs share an anchored k-mer, without listing them.

The number of candidate pairs grows with the square of the pool (a fifth of all pairs at
k = 4), but the accounting only needs its size. A pair is a candidate when at least one of
the left oligo's few anchored k-mers occurs in the right one's reverse complement; inclusion
and exclusion over the non-empty subsets of those k-mers turns that into signed counts of
"subset occurs in the partner". Overlapping k-mers that occur together are identified by the
text they span, so each oligo contributes a fixed number of (pattern, text) rows, and pairs
with left < right are counted per text by ranking. Work is linear in the pool.

Wide windows have too many subsets. There the pool is cut into blocks and stripes of blocks. A task for each two
stripes takes their blocks two by two, marks in a bitmap which right oligos share any anchored k-mer with which left
ones, and counts the marks. Only the bases of the oligos are copied to the tasks of their stripe, and no pair leaves one.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oligoloom.functions.sequence import ALPHABET, MAX_PACKED, kmers, reverse_complement, three_prime_starts
from oligoloom.operators.accept import with_position
from oligoloom.operators.conflicts import PairRules
from oligoloom.operators.skew import spread
from oligoloom.storage import materialize

# Oligos per ranking range; a text that every oligo contains is ranked range by range.
RANGE_BITS = 16
# 2 ** (window - 1) patterns are built per partner; wider windows are counted in bitmaps.
MAX_PATTERN_WINDOW = 5
# Oligos to a block. Stripes of blocks, of whose pairs each is a task; a stripe takes more of them beyond so many blocks.
BLOCK_OLIGOS = 4096
STRIPES, STRIPE_BLOCKS = 24, 64
# Words up to this length get a bitmap each; pairs with longer ones in common are marked so many at a time.
MAX_BITMAP_WORD = 7
_MARKS = 1 << 22
# Left oligos whose bitmaps are united at a time.
_UNITED = 512
_CODES = np.zeros(256, dtype=np.uint8)
_CODES[np.frombuffer(ALPHABET.encode(), dtype=np.uint8)] = np.arange(4)


def _subsets(count: int) -> list[tuple[int, ...]]:
    return [s for size in range(1, count + 1) for s in combinations(range(count), size)]


def _pattern(subset: tuple[int, ...]) -> int:
    return sum(1 << (t - subset[0]) for t in subset)


def _left_terms(pool: DataFrame, k: int, starts: range):
    terms = [
        F.struct(
            F.lit(_pattern(s)).alias("pattern"),
            F.substring("sequence", starts[s[0]] + 1, k + s[-1] - s[0]).alias("text"),
        )
        for s in _subsets(len(starts))
    ]
    return pool.select("idx", F.inline(F.array(*terms)))


def _occurs_at(position: int, k: int):
    return lambda text: F.array_contains(F.col("words"), F.substring(text, F.lit(position + 1), F.lit(k)))


def _tagged(pattern: int):
    return lambda text: F.struct(F.lit(pattern).alias("pattern"), text.alias("text"))


def _right_terms(partners: DataFrame, k: int, length: int, width: int):
    """(pattern, text) for every combination of partner k-mers that some oligo could anchor."""
    rows = partners.withColumn("words", kmers("partner", k, length))
    rows = rows.withColumn("texts_0", F.col("words"))
    for span in range(1, width):
        overlapping = (
            f"flatten(transform(words, u -> transform(filter(words, v -> startswith(v, substring(u, {span + 1}))),"
            f" v -> concat(u, right(v, {span})))))"
        )
        rows = rows.withColumn(f"texts_{span}", F.expr(overlapping))
    parts = []
    for subset in _subsets(width):
        if subset[0]:
            continue
        texts = F.col(f"texts_{subset[-1]}")
        for inner in subset[1:-1]:
            texts = F.filter(texts, _occurs_at(inner, k))
        parts.append(F.transform(texts, _tagged(_pattern(subset))))
    return rows.select("idx", "is_new", F.inline(F.concat(*parts)))


def _ordered_matches(left: DataFrame, right: DataFrame, range_bits: int) -> DataFrame:
    """Per (pattern, text): the number of (left, right) rows with left idx < right idx, of all and of new right rows."""
    rows = left.select("pattern", "text", "idx", F.lit(1).alias("is_left"), F.lit(0).alias("is_new")).unionAll(
        right.select("pattern", "text", "idx", F.lit(0).alias("is_left"), F.col("is_new").cast("int").alias("is_new"))
    )
    rows = rows.withColumn("range", F.shiftright("idx", range_bits))
    inside = (
        Window.partitionBy("pattern", "text", "range")
        .orderBy("idx", "is_left")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranges = (
        rows.withColumn("lefts_so_far", F.sum("is_left").over(inside))
        .groupBy("pattern", "text", "range")
        .agg(
            F.sum((1 - F.col("is_left")) * F.col("lefts_so_far")).alias("within"),
            F.sum(F.col("is_new") * F.col("lefts_so_far")).alias("within_new"),
            F.sum("is_left").alias("lefts"),
            F.sum(1 - F.col("is_left")).alias("rights"),
            F.sum("is_new").alias("new_rights"),
        )
    )
    earlier = (
        Window.partitionBy("pattern", "text").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        ranges.withColumn("before", F.coalesce(F.sum("lefts").over(earlier), F.lit(0).cast("long")))
        .groupBy("pattern", "text")
        .agg(
            F.sum(F.col("within") + F.col("before") * F.col("rights")).alias("matches"),
            F.sum(F.col("within_new") + F.col("before") * F.col("new_rights")).alias("new_matches"),
        )
    )


def word_numbers(codes: np.ndarray, k: int, starts: range) -> np.ndarray:
    """(oligos, starts): the number of each word; longer ones than can be packed are told apart by a 64-bit hash."""
    words = np.zeros((len(codes), len(starts)), dtype=np.uint64)
    for begin in range(0, k, MAX_PACKED):
        part = np.zeros_like(words)
        for p in range(begin, min(k, begin + MAX_PACKED)):
            part = part * np.uint64(4) + codes[:, starts.start + p : starts.stop + p]
        words = part if k <= MAX_PACKED else _mixed(words ^ part)
    return words


def _mixed(numbers: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64, after a step so that zero does not stay zero."""
    numbers = numbers + np.uint64(0x9E3779B97F4A7C15)
    numbers = (numbers ^ (numbers >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    numbers = (numbers ^ (numbers >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return numbers ^ (numbers >> np.uint64(31))


def _bits_from(count: int, first: np.ndarray) -> np.ndarray:
    """A row of ``count`` words of 64 bits for each number: the bits from that number on."""
    return np.packbits(np.arange(count * 64) >= first[:, None], axis=1, bitorder="little").view(np.uint64)


def _pairs_by_words(left: np.ndarray, right: np.ndarray, k: int, ordered: bool, new_from: int) -> tuple[int, int]:
    """For short words: a bitmap of the right oligos for each word; those of a left oligo's words are united."""
    size = -(-len(right) // 64)
    owners = np.repeat(np.arange(len(right)), right.shape[1])
    holds = np.zeros((4**k, size), dtype=np.uint64)
    np.bitwise_or.at(holds, (right.ravel().astype(np.int64), owners >> 6), np.uint64(1) << (owners & 63).astype(np.uint64))
    newer = _bits_from(size, np.array([new_from]))
    pairs = new_pairs = 0
    for at in range(0, len(left), _UNITED):
        words = left[at : at + _UNITED].astype(np.int64)
        met = holds[words[:, 0]]
        for column in range(1, words.shape[1]):
            met |= holds[words[:, column]]
        if ordered:
            met &= _bits_from(size, np.arange(at + 1, at + 1 + len(words)))
        pairs += int(np.bitwise_count(met).sum(dtype=np.int64))
        new_pairs += int(np.bitwise_count(met & newer).sum(dtype=np.int64))
    return pairs, new_pairs


def _pairs_by_marks(left: np.ndarray, right: np.ndarray, ordered: bool, new_from: int) -> tuple[int, int]:
    """For long words, which few oligos share: the pairs of every shared word are marked."""
    marks = np.zeros((len(left), len(right)), dtype=bool)
    left_owner, right_owner = (np.repeat(np.arange(len(side)), side.shape[1]) for side in (left, right))
    left, order = left.ravel(), np.argsort(right.ravel(), kind="stable")
    right, right_owner = right.ravel()[order], right_owner[order]
    first = np.searchsorted(right, left, side="left")
    sizes = np.searchsorted(right, left, side="right") - first
    ends = np.cumsum(sizes)
    at = 0
    while at < len(left):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _MARKS, side="right")))
        count = sizes[at:stop]
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        marks[np.repeat(left_owner[at:stop], count), right_owner[np.repeat(first[at:stop], count) + inside]] = True
        at = stop
    if ordered:
        marks = np.triu(marks, 1)
    return int(np.count_nonzero(marks)), int(np.count_nonzero(marks[:, new_from:]))


def marked_pairs(left: np.ndarray, right: np.ndarray, k: int, ordered: bool, new_from: int) -> tuple[int, int]:
    """How many (left, right) oligos of two blocks share a word, and how many of these from right ``new_from`` on.

    Both are rows of word numbers, one for each oligo; ``ordered``: only left before right, in one block.
    """
    if k <= MAX_BITMAP_WORD:
        return _pairs_by_words(left, right, k, ordered, new_from)
    return _pairs_by_marks(left, right, ordered, new_from)


def _count_in_cells(pool: DataFrame, k: int, length: int, starts: range, first_new: int | None, whole: bool) -> DataFrame:
    """One row, ``pairs`` and ``new_pairs``; ``pool``: (idx, sequence). ``whole``: both ends may be old."""
    placed = with_position(pool, "idx", "place").withColumn("block", F.expr(f"place div {BLOCK_OLIGOS}"))
    old = F.lit(False) if first_new is None else F.col("idx") < first_new
    rows = F.transform(F.array_sort(F.collect_list(F.struct("place", "sequence"))), lambda row: row["sequence"])
    # An oligo goes to the cells of its stripe as its bases; words are cut there.
    blocks = materialize(
        placed.groupBy("block").agg(F.concat_ws("", rows).alias("bases"), F.count_if(old).alias("new_from")), "blocks"
    )
    last = blocks.agg(F.max("block")).first()[0] or 0
    wide = min(-(-(last + 1) // STRIPES), STRIPE_BLOCKS)
    stripes = last // wide + 1
    blocks = blocks.withColumn("own", F.expr(f"block div {wide}"))
    rights = blocks if whole else blocks.where(f"new_from * {length} < length(bases)")
    later, earlier = F.sequence(F.col("own"), F.lit(stripes - 1)), F.sequence(F.lit(0).cast("long"), F.col("own"))
    columns = ["block", "bases", "new_from"]
    left = blocks.select(F.col("own").alias("i"), F.explode(later).alias("j"), F.lit(True).alias("is_left"), *columns)
    right = rights.select(F.explode(earlier).alias("i"), F.col("own").alias("j"), F.lit(False).alias("is_left"), *columns)

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        sides: dict[bool, list] = {True: [], False: []}
        for row in rows.itertuples():
            codes = _CODES[np.frombuffer(row.bases.encode(), dtype=np.uint8)].reshape(-1, length)
            if not row.is_left:
                codes = 3 - codes[:, ::-1]
            words = word_numbers(codes, k, starts if row.is_left else range(length - k + 1))
            sides[row.is_left].append((row.block, words, row.new_from))
        pairs = new_pairs = 0
        for right_block, right_words, new_from in sides[False]:
            for left_block, left_words, _ in sides[True]:
                if left_block <= right_block:
                    found = marked_pairs(left_words, right_words, k, left_block == right_block, new_from)
                    pairs, new_pairs = pairs + found[0], new_pairs + found[1]
        return pd.DataFrame({"pairs": [pairs], "new_pairs": [new_pairs]})

    cells = left.unionByName(right).repartition(stripes * (stripes + 1) // 2, "i", "j")
    counted = cells.groupBy("i", "j").applyInPandas(count, "pairs long, new_pairs long")
    return counted.agg(*[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in ("pairs", "new_pairs")])


def candidate_pair_counts(
    pool: DataFrame,
    k: int,
    rules: PairRules,
    seq: str = "sequence",
    order: str = "idx",
    first_new: int | None = None,
    range_bits: int = RANGE_BITS,
    whole: bool = True,
) -> DataFrame:
    """One row, ``pairs`` and ``new_pairs``: the sizes of ``candidate_pairs(pool, k, ...)`` without and with ``first_new``.

    Both are counted in one pass. Not ``whole``: ``pairs`` may leave pairs of old oligos out.
    """
    starts = three_prime_starts(rules.length, k, rules.window)
    width = len(starts)
    named = pool.select(F.col(order).alias("idx"), F.col(seq).alias("sequence"))
    if width > MAX_PATTERN_WINDOW or width - 1 > k:
        return _count_in_cells(named, k, rules.length, starts, first_new, whole)
    pool = spread(named, "idx", pool.count())
    zero = F.lit(0).cast("long")
    if not width:
        return pool.agg(zero.alias("pairs"), zero.alias("new_pairs"))
    is_new = F.lit(True) if first_new is None else F.col("idx") >= first_new
    partners = pool.select("idx", is_new.alias("is_new"), reverse_complement(F.col("sequence")).alias("partner"))
    matches = _ordered_matches(
        _left_terms(pool, k, starts),
        _right_terms(partners if whole else partners.where("is_new"), k, rules.length, width),
        range_bits,
    )
    sign = F.when(F.bit_count("pattern") % 2 == 1, 1).otherwise(-1)
    return matches.agg(
        F.coalesce(F.sum(sign * F.col("matches")), zero).alias("pairs"),
        F.coalesce(F.sum(sign * F.col("new_matches")), zero).alias("new_pairs"),
    )


def candidate_pair_count(
    pool: DataFrame,
    k: int,
    rules: PairRules,
    seq: str = "sequence",
    order: str = "idx",
    first_new: int | None = None,
    range_bits: int = RANGE_BITS,
) -> DataFrame:
    """One row, ``pairs``: the size of ``candidate_pairs(pool, k, ...)``."""
    counts = candidate_pair_counts(pool, k, rules, seq, order, first_new, range_bits, whole=first_new is None)
    return counts.select(F.col("new_pairs").alias("pairs"))


def pair_slots(pool: DataFrame, order: str = "idx", first_new: int | None = None) -> DataFrame:
    """One row: oligos, how many are new, and the pairs with at least one new member."""
    is_new = F.lit(True) if first_new is None else F.col(order) >= first_new
    counts = pool.agg(F.count(F.lit(1)).alias("oligos"), F.count_if(is_new).alias("new_oligos"))
    old, new = F.col("oligos") - F.col("new_oligos"), F.col("new_oligos")
    return counts.withColumn("pair_slots", old * new + F.expr("new_oligos * (new_oligos - 1) div 2"))


def pair_accounting(
    pool: DataFrame,
    rules: PairRules,
    seq: str = "sequence",
    order: str = "idx",
    first_new: int | None = None,
) -> DataFrame:
    """One row: how many pair slots fall below the minimum run, between it and the gate, or
    get a melting temperature."""
    at_min = candidate_pair_count(pool, rules.min_run, rules, seq, order, first_new)
    at_active = at_min
    if rules.active_run != rules.min_run:
        at_active = candidate_pair_count(pool, rules.active_run, rules, seq, order, first_new)
    parts = (
        pair_slots(pool, order, first_new)
        .select(F.lit("slots").alias("part"), F.col("pair_slots").alias("n"))
        .unionAll(at_min.select(F.lit("min"), "pairs"))
        .unionAll(at_active.select(F.lit("active"), "pairs"))
    )
    totals = parts.agg(
        F.sum(F.when(F.col("part") == "slots", F.col("n"))).alias("pair_slots"),
        F.sum(F.when(F.col("part") == "min", F.col("n"))).alias("min_pairs"),
        F.sum(F.when(F.col("part") == "active", F.col("n"))).alias("active_pairs"),
    )
    return totals.select(
        "pair_slots",
        (F.col("pair_slots") - F.col("min_pairs")).alias("below_min_alignment_run"),
        (F.col("min_pairs") - F.col("active_pairs")).alias("tms_shortcircuited"),
        F.col("active_pairs").alias("tm_evaluations"),
    )
