"""Candidate proposals that depend on (seed, attempt) alone.

Every attempt is computed from a hash of the seed and its own number, so any range of attempts
can be produced anywhere, again and in any order: proposing needs no shuffle, lost tasks are
simply redone, and resuming means continuing at the next number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oligoloom.functions.sequence import ALPHABET, gc_bounds

ATTEMPTS_PER_TASK = 5_000_000


def attempts(spark: SparkSession, first: int, last: int) -> DataFrame:
    """Attempt numbers ``first`` to ``last``, both included."""
    tasks = max(spark.sparkContext.defaultParallelism, (last - first) // ATTEMPTS_PER_TASK + 1)
    return spark.range(first, last + 1, 1, tasks).select(F.col("id").alias("attempt_id"))


# Slots that one SHA-256 digest feeds, with six hexadecimal digits each; four more are left over.
_SLOTS, _DIGITS = 10, 6


def _hex_number(digest: str, first: int, digits: int) -> Column:
    return F.conv(F.substring(digest, first + 1, digits), 16, 10).cast("long")


def gc_balanced(rows: DataFrame, seed: int, length: int, gc_low: float, gc_high: float) -> DataFrame:
    """``rows`` (attempt_id) with a random ``sequence`` whose GC count is uniform within the bounds.

    Each slot gets a number; the first ``gc`` slots use one bit of it to choose between G and C, the others
    between A and T. Sorting the numbers shuffles the slots. The numbers come from digests of the seed, the
    attempt and the block of slots, so that other engines can follow the draw.
    """
    least, most = gc_bounds(length, gc_low, gc_high)
    blocks = range(-(-length // _SLOTS))
    for block in blocks:
        text = F.concat_ws("-", F.lit(str(seed)), F.col("attempt_id").cast("string"), F.lit(str(block)))
        rows = rows.withColumn(f"__digest{block}", F.sha2(text.cast("binary"), 256))
    rows = rows.withColumn("__gc", _hex_number("__digest0", _SLOTS * _DIGITS, 4) % (most - least + 1) + least)
    slots = []
    for slot in range(length):
        draw = _hex_number(f"__digest{slot // _SLOTS}", slot % _SLOTS * _DIGITS, _DIGITS)
        coin = draw.bitwiseAND(1)
        # Base codes A=0 C=1 G=2 T=3: C or G against A or T. Equal draws keep the order of their slots.
        base = F.when(F.lit(slot) < F.col("__gc"), coin + 1).otherwise(coin * 3)
        slots.append(draw * (4 * length) + (4 * slot) + base)
    shuffled = F.sort_array(F.array(*slots))
    letters = F.transform(shuffled, lambda v: F.substring(F.lit(ALPHABET), (v % 4 + 1).cast("int"), F.lit(1)))
    return rows.withColumn("sequence", F.array_join(letters, ""))


def propose(rows: DataFrame, seed: int, length: int, gc_low: float, gc_high: float) -> DataFrame:
    """Candidates for a DataFrame of ``attempt_id`` values."""
    return gc_balanced(rows.select("attempt_id"), seed, length, gc_low, gc_high).select("attempt_id", "sequence")


def enumerate_sequences(spark: SparkSession, length: int) -> DataFrame:
    """All sequences of a (short) length in alphabetical order, ``id`` being the packed code."""
    digits = [
        F.substring(F.lit(ALPHABET), (F.shiftright(F.col("id"), 2 * place).bitwiseAND(3) + 1).cast("int"), F.lit(1))
        for place in reversed(range(length))
    ]
    return spark.range(4**length).select("id", F.concat(*digits).alias("sequence"))
