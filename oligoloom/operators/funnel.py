"""First-failure filter funnel and its accounting."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oligoloom.functions.melting import Chemistry, with_intrinsic_tm
from oligoloom.functions.motifs import (
    contains_motif,
    homopolymer_exceeds,
    near_palindrome,
    repeat_exceeds,
    self_complementary,
)
from oligoloom.functions.sequence import MAX_PACKED, pack, reverse_complement
from oligoloom.functions.staging import stage

# Stage names in the order in which a candidate is charged.
FUNNEL_ORDER = (
    "duplicate",
    "homopolymer",
    "trinucleotide_repeat",
    "intrinsic_tm",
    "dinucleotide_repeat",
    "forbidden_motif",
    "self_complementarity",
    "near_palindrome",
)


@dataclass(frozen=True)
class FunnelSettings:
    length: int
    tm_min_c: float = 60.0
    tm_max_c: float = 70.0
    max_homopolymer: int = 3
    max_dinucleotide_repeats: int = 3
    max_trinucleotide_repeats: int = 2
    near_palindrome_min_match: int = 16
    self_complementarity_threshold: int = 6
    motifs: tuple[str, ...] = ()
    chemistry: Chemistry = field(default_factory=Chemistry)


def with_reason(rows: DataFrame, settings: FunnelSettings, seq: str = "sequence") -> DataFrame:
    """Add ``intrinsic_tm_c`` and ``reason``, the first filter the sequence fails (null: none).

    Cheap and selective tests come first and CASE stops at the first hit, so the costly
    self-pairing tests, and the reverse complement they need, only run on the few rows that
    get that far. Purely row-local: no shuffle.
    """
    n, text = settings.length, F.col(seq)
    packed = None
    if n <= MAX_PACKED:
        packed = "__packed"
        rows = rows.withColumn(packed, pack(text))
    code = F.col(packed) if packed else None
    rows = with_intrinsic_tm(rows, seq, "__tm", n, settings.chemistry, packed=packed, fixed=n >= 2)
    tm = F.col("__tm")
    simple = (
        F.when(homopolymer_exceeds(text, n, settings.max_homopolymer, code), "homopolymer")
        .when(repeat_exceeds(text, n, 3, settings.max_trinucleotide_repeats, code), "trinucleotide_repeat")
        .when((tm < settings.tm_min_c) | (tm > settings.tm_max_c), "intrinsic_tm")
        .when(repeat_exceeds(text, n, 2, settings.max_dinucleotide_repeats, code), "dinucleotide_repeat")
        .when(contains_motif(text, settings.motifs), "forbidden_motif")
    )
    rows = rows.withColumn("__simple", simple)
    rows = rows.withColumn("__rc", F.when(F.col("__simple").isNull(), reverse_complement(text)))
    full = (
        F.when(F.col("__simple").isNotNull(), F.col("__simple"))
        .when(self_complementary(seq, "__rc", n, settings.self_complementarity_threshold), "self_complementarity")
        .when(near_palindrome(seq, "__rc", n, settings.near_palindrome_min_match), "near_palindrome")
    )
    return stage(rows, {"intrinsic_tm_c": tm, "reason": full}).drop("__packed", "__simple", "__rc", "__tm")


def first_occurrences(candidates: DataFrame, seq: str = "sequence", order: str = "attempt_id") -> DataFrame:
    """Distinct sequences with their earliest attempt and the number of proposals.

    A min/count aggregate combines on the map side, so a sequence proposed by a third of all
    rows still arrives as one row per task; a ranking window would collect it in one.
    """
    return candidates.groupBy(seq).agg(
        F.min(order).alias(order), F.count(F.lit(1)).alias("proposals")
    )


def survivors(
    candidates: DataFrame, settings: FunnelSettings, seq: str = "sequence", order: str = "attempt_id"
) -> DataFrame:
    """Accepted sequences at their earliest attempt.

    The verdict depends on the sequence alone, so it is taken before the deduplicating
    shuffle, which then only carries the rows that passed.
    """
    passed = with_reason(candidates.select(order, seq), settings, seq).where(F.col("reason").isNull())
    return passed.groupBy(seq).agg(F.min(order).alias(order), F.first("intrinsic_tm_c").alias("intrinsic_tm_c"))


def funnel_totals(
    candidates: DataFrame, settings: FunnelSettings, seq: str = "sequence", order: str = "attempt_id"
) -> DataFrame:
    """One row: attempts, accepted and the rejections per stage.

    Every repeat of a sequence counts as a duplicate, whatever happened to its first proposal.
    """
    return _totals(with_reason(first_occurrences(candidates, seq, order), settings, seq))


def totals_of_verdicts(verdicts: DataFrame, seq: str = "sequence") -> DataFrame:
    """The same from rows that have been judged already (``with_reason``)."""
    return _totals(verdicts.groupBy(seq).agg(F.count(F.lit(1)).alias("proposals"), F.min("reason").alias("reason")))


def _totals(distinct: DataFrame) -> DataFrame:
    stages = [F.count_if(F.col("reason") == name).alias(name) for name in FUNNEL_ORDER[1:]]
    zero = F.lit(0).cast("long")
    return distinct.agg(
        F.coalesce(F.sum("proposals"), zero).alias("attempts"),
        F.count_if(F.col("reason").isNull()).alias("accepted"),
        F.coalesce(F.sum(F.col("proposals") - 1), zero).alias("duplicate"),
        *stages,
    )


def reason_counts(totals: DataFrame) -> DataFrame:
    """Totals as (reason, n) rows, acceptances included, zero counts left out."""
    names = (*FUNNEL_ORDER, "accepted")
    pairs = F.array(*[F.struct(F.lit(n).alias("reason"), F.col(n).alias("n")) for n in names])
    return totals.select(F.inline(pairs)).where("n > 0")


def funnel_table(totals: DataFrame) -> DataFrame:
    """Per stage, in funnel order: failures and their share of attempts and of arrivals."""
    stages = F.array(
        *[
            F.struct(F.lit(i).alias("stage"), F.lit(name).alias("filter"), F.col(name).alias("count"))
            for i, name in enumerate(FUNNEL_ORDER)
        ]
    )
    # Eight rows by construction, so one ordered frame is no bottleneck.
    before = Window.partitionBy("attempts").orderBy("stage").rowsBetween(Window.unboundedPreceding, -1)
    reaching = F.col("attempts") - F.coalesce(F.sum("count").over(before), F.lit(0).cast("long"))
    rows = totals.select("attempts", F.inline(stages)).withColumn("attempts_reaching_filter", reaching)
    return rows.select(
        "stage",
        "filter",
        "count",
        safe_rate("count", "attempts").alias("fraction_of_attempts"),
        "attempts_reaching_filter",
        safe_rate("count", "attempts_reaching_filter").alias("fraction_of_reaching_filter"),
    )


def safe_rate(numerator: str, denominator: str):
    return F.coalesce(F.try_divide(F.col(numerator).cast("double"), F.col(denominator)), F.lit(0.0))
