"""Dense positions in acceptance order and the first-N cut."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oligoloom.functions.sequence import gc_fraction, reverse_complement
from oligoloom.storage import is_stored, materialize

# Rows that one task numbers: not so few that tasks cost more than rows, not more than it sorts well.
LEAST_ROWS, MOST_ROWS = 10_000, 2_000_000
# Ranges that a selection counts at a time.
_RANGES = 1024
# monotonically_increasing_id keeps the partition above this many bits of row number.
_ROW_BITS = 33


def with_position(rows: DataFrame, order: str | tuple[str, ...], out: str = "idx") -> DataFrame:
    """Number the rows 0, 1, 2, ... by a unique LONG column, or by columns that are unique together.

    ``rows`` is evaluated once, into a table unless it is one. Its rows are dealt into ranges of ``order`` and numbered inside
    them; the sizes of the ranges, one number per task, give each range its first position.
    """
    spark = rows.sparkSession
    once = rows if is_stored(rows) else materialize(rows, "to-number")
    usual, count = int(spark.conf.get("spark.sql.shuffle.partitions")), once.count()
    tasks = max(1, min(usual, -(-count // LEAST_ROWS)), -(-count // MOST_ROWS))
    keys = (order,) if isinstance(order, str) else order
    ranged = once.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    placed = materialize(ranged.withColumn("__place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__place", _ROW_BITS)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    before = accumulate((r.n for r in sizes), initial=0)
    starts = spark.createDataFrame([(r.part, b) for r, b in zip(sizes, before)], "__part long, __before long")
    inside = F.col("__place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.withColumn("__part", part)
        .join(F.broadcast(starts), "__part")
        .withColumn(out, F.col("__before") + inside)
        .drop("__part", "__place", "__before")
    )


def nth_smallest(rows: DataFrame, order: str, n: int) -> int | None:
    """The ``n``-th smallest value of a unique LONG column (null: there are fewer), without sorting.

    Counts of equal ranges tell which range holds it; that range is divided again until one value is left. Each
    step reads one column and sends about ``_RANGES`` numbers to the driver.
    """
    ends = rows.agg(F.min(order).alias("low"), F.max(order).alias("high"), F.count(order).alias("n")).first()
    if n < 1 or ends.n < n:
        return None
    low, high, before = ends.low, ends.high, 0
    while low < high:
        width = (high - low) // _RANGES + 1
        inside = rows.where(F.col(order).between(low, high))
        part = F.expr(f"{order} div {width}L - if({order} % {width}L < 0, 1, 0)")
        for part_no, count in sorted(tuple(r) for r in inside.groupBy(part.alias("part")).count().collect()):
            if before + count >= n:
                low, high = max(low, part_no * width), min(high, (part_no + 1) * width - 1)
                break
            before += count
    return low


def first_rows(rows: DataFrame, size: int, order: str) -> DataFrame:
    """The ``size`` rows that come first, in no order; all if there are fewer. ``rows`` should be a stored table."""
    cut = nth_smallest(rows, order, size)
    if cut is None:
        return rows if size > 0 else rows.limit(0)
    return rows.where(F.col(order) <= cut)


def accept_first(rows: DataFrame, size: int, order: str = "attempt_id") -> DataFrame:
    """The first ``size`` survivors in attempt order, numbered from 0; only these are sorted."""
    return with_position(first_rows(materialize(rows, "survivors"), size, order), order)


def oligo_records(rows: DataFrame, seq: str = "sequence") -> DataFrame:
    """Add the derived columns of an accepted oligo."""
    return rows.withColumn("reverse_complement", reverse_complement(F.col(seq))).withColumn(
        "gc_fraction", gc_fraction(F.col(seq))
    )


def output_rows(records: DataFrame, *leading: str) -> DataFrame:
    """Output schema: four columns, fractions and temperatures at four decimals."""
    return records.select(
        *leading,
        "sequence",
        "reverse_complement",
        F.round("gc_fraction", 4).alias("gc_fraction"),
        F.round("intrinsic_tm_c", 4).alias("intrinsic_tm_c"),
    )
