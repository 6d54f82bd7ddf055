"""Propose, filter and accept until enough oligos are found."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from oligoloom.config import RunConfig
from oligoloom.operators.accept import nth_smallest, with_position
from oligoloom.operators.funnel import FUNNEL_ORDER, FunnelSettings, with_reason
from oligoloom.sources.proposals import attempts, propose
from oligoloom.storage import materialize

# (spark, first attempt, last attempt) -> attempt_id, sequence
Source = Callable[[SparkSession, int, int], DataFrame]

MIN_BATCH = 10_000
FIRST_GUESS = 20  # attempts per oligo before anything is known about the acceptance rate


def proposal_source(config: RunConfig, seed: int) -> Source:
    def source(spark: SparkSession, first: int, last: int) -> DataFrame:
        return propose(attempts(spark, first, last), seed, config.generator.primer_length, *config.gc_range)

    return source


def batch_size(missing: int, tried: int, found: int) -> int:
    per_oligo = 1.1 * tried / found if found else FIRST_GUESS
    return max(MIN_BATCH, math.ceil(missing * per_oligo))


@dataclass
class Batch:
    """Newly accepted oligos (idx from 0) and their number, the attempt after which to continue, the verdicts of all
    attempts up to it, and what the write of the batch saw pass: judged attempts by reason, repeats included."""

    rows: DataFrame
    count: int
    reached: int
    verdicts: DataFrame
    observed: dict[str, int]


def next_batch(
    spark: SparkSession,
    source: Source,
    settings: FunnelSettings,
    seen: DataFrame,
    first: int,
    last: int,
    missing: int,
) -> Batch:
    """Newly accepted oligos from attempts first..last, at most ``missing`` of them.

    Every attempt is judged once, into a table. It ends at the attempt that filled the quota, or at ``last``. Rejected
    sequences need no memory to be rejected again; accepted ones do (``seen``).
    """
    seen_passing = Observation()
    reasons = [F.count_if(F.col("reason") == name).alias(name) for name in FUNNEL_ORDER[1:]]
    judged = with_reason(source(spark, first, last).select("attempt_id", "sequence"), settings)
    judged = judged.observe(seen_passing, F.count(F.lit(1)).alias("judged"), *reasons)
    verdicts = materialize(judged, "verdicts")
    fresh = verdicts.where("reason is null").groupBy("sequence").agg(
        F.min("attempt_id").alias("attempt_id"), F.first("intrinsic_tm_c").alias("intrinsic_tm_c")
    )
    fresh = materialize(fresh.join(seen, "sequence", "left_anti"), "fresh")
    cut = nth_smallest(fresh, "attempt_id", missing)
    if cut is None:
        rows = materialize(with_position(fresh, "attempt_id"), "batch")
        return Batch(rows, fresh.count(), last, verdicts, seen_passing.get)
    rows = materialize(with_position(fresh.where(F.col("attempt_id") <= cut), "attempt_id"), "batch")
    return Batch(rows, missing, cut, verdicts.where(F.col("attempt_id") <= cut), seen_passing.get)
