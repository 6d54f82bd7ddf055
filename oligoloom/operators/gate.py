"""Shortest run that can exceed a melting-temperature threshold.

A run inside an accepted oligo obeys the repeat limits and must fit the oligo's GC bounds. The
search extends all admissible sequences base by base. Whether a sequence melts above T depends
on a sum over neighbouring bases (1000 dH - T dS), so of all sequences that can be continued in
the same ways, i.e. with the same recent bases and GC count, only the best one per threshold
has to be kept. The frontier therefore stops growing once it is longer than the longest repeat
window, and a threshold no oligo can reach ends at the oligo length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oligoloom.functions.melting import KELVIN, NEIGHBOUR_PARAMETERS, TERMINAL_AT, TERMINAL_GC, double_sql, with_intrinsic_tm
from oligoloom.functions.sequence import ALPHABET, gc_count, gc_embeddable
from oligoloom.operators.funnel import FunnelSettings
from oligoloom.sources.proposals import enumerate_sequences
from oligoloom.storage import materialize

# Lengths up to this one are enumerated outright: at most 4,096 sequences.
LISTED_LENGTH = 6


@dataclass(frozen=True)
class Gate:
    """Per label: the shortest length above its threshold and a sequence that shows it."""

    lengths: dict[str, int]
    examples: dict[str, tuple[str, float]]
    interrupted: bool = False


def repeat_windows(settings: FunnelSettings) -> list[tuple[int, int]]:
    """(unit, forbidden number of copies) of the repeat limits that can bite at this length."""
    limits = [(1, settings.max_homopolymer + 1)]
    for unit, limit in ((2, settings.max_dinucleotide_repeats), (3, settings.max_trinucleotide_repeats)):
        if limit > 0:
            limits.append((unit, limit + 1))
    return [(unit, copies) for unit, copies in limits if unit * copies <= settings.length]


def _ends_in_repeat(text: Column, unit: int, copies: int) -> Column:
    width = unit * copies
    earlier = F.substring(text, -width, width - unit)
    later = F.substring(text, -(width - unit), width - unit)
    return (F.length(text) >= width) & (earlier == later)


def admissible(seq: Column, length: int, settings: FunnelSettings, gc_low: float, gc_high: float) -> Column:
    """The repeat and GC rules on a whole sequence of ``length`` bases."""
    ok = gc_embeddable(gc_count(seq), length, settings.length, gc_low, gc_high)
    for unit, copies in repeat_windows(settings):
        for last in range(unit * copies, length + 1):
            ok = ok & ~_ends_in_repeat(F.substring(seq, 1, last), unit, copies)
    return ok


def _pair_costs(threshold_c: float) -> dict[str, float]:
    """Neighbour pair -> 1000 dH - T dS; the lower, the hotter."""
    kelvin = threshold_c + KELVIN
    return {pair: 1000 * dh - kelvin * ds for pair, (dh, ds) in NEIGHBOUR_PARAMETERS.items()}


def _cost_map_sql(threshold_c: float) -> str:
    entries = [f"'{pair}', {double_sql(cost)}" for pair, cost in _pair_costs(threshold_c).items()]
    return f"map({', '.join(entries)})"


def _cost(threshold_c: float, length: int) -> Column:
    """Cost of a whole sequence without the end term of its last base.

    Candidates that are compared share their last bases, so that term would not matter.
    """
    kelvin = threshold_c + KELVIN
    at, gc = (1000 * dh - kelvin * ds for dh, ds in (TERMINAL_AT, TERMINAL_GC))
    first = f"if(left(sequence, 1) in ('A', 'T'), {double_sql(at)}, {double_sql(gc)})"
    table = _cost_map_sql(threshold_c)
    pairs = [f"element_at({table}, substring(sequence, {p + 1}, 2))" for p in range(length - 1)]
    return F.expr(" + ".join([first, *pairs]))


class _Found:
    """Shortest length and example per label."""

    def __init__(self, thresholds: dict[str, float]) -> None:
        self.thresholds = thresholds
        self.lengths: dict[str, int] = {}
        self.examples: dict[str, tuple[str, float]] = {}

    def offer(self, label: str, length: int, sequence: str, tm_c: float) -> None:
        if label not in self.lengths and tm_c > self.thresholds[label]:
            self.lengths[label] = length
            self.examples[label] = (sequence, tm_c)


def _extend(frontier: DataFrame, labels: dict[str, float], context: int, length: int, rules) -> DataFrame:
    settings, gc_low, gc_high = rules
    rows = frontier.withColumn("base", F.explode(F.array(*[F.lit(b) for b in ALPHABET])))
    rows = rows.withColumn("recent", F.concat("tail", "base"))
    rows = rows.withColumn("gc", F.col("gc") + F.col("base").isin("G", "C").cast("int"))
    ok = gc_embeddable(F.col("gc"), length, settings.length, gc_low, gc_high)
    for unit, copies in repeat_windows(settings):
        ok = ok & ~_ends_in_repeat(F.col("recent"), unit, copies)
    rows = rows.where(ok)
    best = []
    for label, threshold in labels.items():
        step = F.expr(f"element_at({_cost_map_sql(threshold)}, right(recent, 2))")
        cost = F.col(f"{label}.cost") + step
        grown = F.struct(cost.alias("cost"), F.concat(F.col(f"{label}.sequence"), F.col("base")).alias("sequence"))
        best.append(F.min(grown).alias(label))
    return rows.groupBy(F.substring("recent", -context, context).alias("tail"), "gc").agg(*best)


def gate_lengths(
    spark: SparkSession,
    settings: FunnelSettings,
    gc_low: float,
    gc_high: float,
    thresholds: dict[str, float],
) -> Gate:
    """Gate length per label; ``settings.length + 1`` where the threshold is out of reach."""
    rules = (settings, gc_low, gc_high)
    context = max([1] + [unit * copies - 1 for unit, copies in repeat_windows(settings)])
    found = _Found(thresholds)
    # Short lengths are simply listed, all in one job; the frontier starts at the longest of them.
    listed = min(context, LISTED_LENGTH, settings.length)
    short = None
    for length in range(1, listed + 1):
        rows = enumerate_sequences(spark, length).where(admissible(F.col("sequence"), length, *rules))
        rows = rows.select("sequence", F.lit(length).alias("length"))
        short = rows if short is None else short.unionAll(rows)
    short = materialize(short, "gate-listed")
    hot = with_intrinsic_tm(short, "sequence", "tm_c", listed, settings.chemistry)
    best = hot.groupBy("length").agg(F.max(F.struct("tm_c", "sequence")).alias("best"))
    for row in sorted(best.collect(), key=lambda row: row.length):
        for label in thresholds:
            found.offer(label, row.length, row.best.sequence, row.best.tm_c)

    text = F.col("sequence")
    frontier = short.where(F.col("length") == listed).select(
        F.substring(text, -context, context).alias("tail"),
        gc_count(text).alias("gc"),
        *[F.struct(_cost(t, listed).alias("cost"), text.alias("sequence")).alias(label) for label, t in thresholds.items()],
    )
    length, interrupted = listed, False
    while length < settings.length:
        open_labels = {label: t for label, t in thresholds.items() if label not in found.lengths}
        if not open_labels:
            break
        length += 1
        try:
            frontier = materialize(_extend(frontier, open_labels, context, length, rules), "gate-frontier")
        except KeyboardInterrupt:
            interrupted = True
            break
        heads = [F.struct(F.lit(x).alias("label"), F.col(f"{x}.sequence").alias("sequence")) for x in open_labels]
        best = frontier.select(F.inline(F.array(*heads)))
        best = with_intrinsic_tm(best, "sequence", "tm_c", length, settings.chemistry, fixed=length >= 2)
        best = best.groupBy("label").agg(F.max(F.struct("tm_c", "sequence")).alias("best"))
        for row in best.collect():
            found.offer(row.label, length, row.best.sequence, row.best.tm_c)
    # An interrupted search vouches for the length it was working on.
    open_end = length if interrupted else settings.length + 1
    return Gate({label: found.lengths.get(label, open_end) for label in thresholds}, found.examples, interrupted)
