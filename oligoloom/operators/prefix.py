"""The first N acceptances of a candidate table, with the counters up to them.

Candidates are judged in attempt order, as far as the rate of acceptance so far says is needed, and every attempt at
most once: what was judged is a stored table from which both the accepted rows and the counters come. The cut, the
attempt that fills the quota, is selected by counts of ranges; nothing behind it is sorted, and attempts behind the
last stretch are not judged.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oligoloom.operators.accept import nth_smallest, with_position
from oligoloom.operators.funnel import FunnelSettings, totals_of_verdicts, with_reason
from oligoloom.storage import materialize

# Attempts in the first stretch for each oligo that is wanted, and at least.
FIRST_GUESS, LEAST_ATTEMPTS = 20, 10_000


@dataclass
class Prefix:
    """``rows``: (attempt_id, sequence, intrinsic_tm_c, idx); ``totals``: see ``funnel.funnel_totals``."""

    rows: DataFrame
    totals: DataFrame
    # The last attempt that counts, null without candidates, and how many attempts were judged.
    cut: int | None
    judged: int


def accept_to_cut(
    candidates: DataFrame, settings: FunnelSettings, size: int, least_attempts: int = LEAST_ATTEMPTS
) -> Prefix:
    """``candidates``: (attempt_id, sequence), attempts unique; a sequence counts at its first attempt."""
    total = candidates.count()
    done, found, reached = 0, 0, None
    judged = None
    first = accepted = None
    while done < total and found < size or judged is None:
        per_oligo = 1.1 * done / found if found else FIRST_GUESS
        done = min(total, done + max(least_attempts, math.ceil((size - found) * per_oligo)))
        last = nth_smallest(candidates, "attempt_id", done)
        rows = candidates.where(F.col("attempt_id") <= last) if last is not None else candidates
        if reached is not None:
            rows = rows.where(F.col("attempt_id") > reached)
        verdicts = materialize(with_reason(rows, settings), "verdicts")
        judged = verdicts if judged is None else judged.unionAll(verdicts)
        reached = last
        first = judged.where("reason is null").groupBy("sequence")
        accepted = materialize(
            first.agg(F.min("attempt_id").alias("attempt_id"), F.first("intrinsic_tm_c").alias("intrinsic_tm_c")),
            "accepted",
        )
        found = accepted.count()
    cut = nth_smallest(accepted, "attempt_id", size) if size > 0 else None
    if cut is None:
        cut = reached if size > 0 else None
    up_to = F.col("attempt_id") <= cut if cut is not None else F.lit(False)
    rows = with_position(accepted.where(up_to).select("attempt_id", "sequence", "intrinsic_tm_c"), "attempt_id")
    return Prefix(rows, totals_of_verdicts(judged.where(up_to)), cut, done)
