"""Rates over the last W rows of an ordered table, in parallel.

Rows are numbered in ranges and cut into blocks; the last W - 1 rows of a block are handed on to the next one as well, so
that every block can look back as far as it needs to. No window spans the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oligoloom.operators.accept import with_position

BLOCK_ROWS = 100_000


def rolling_share(
    rows: DataFrame, order: str, happened: Column, window: int, out: str = "share", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add the share of the last ``window`` rows, up to and with the row itself, in which ``happened`` is true.

    ``order`` is a unique LONG column. The first rows look back on as many rows as there are; null counts as false.
    """
    if window < 1:
        raise ValueError("a window holds at least one row")
    size = max(block_rows, window)
    counts = F.coalesce(happened, F.lit(False)).cast("int")
    placed = with_position(rows.withColumn("__happened", counts), order, "__nth")
    block, inside = F.expr(f"__nth div {size}"), F.col("__nth") % size
    both = F.when(inside > size - window, F.array(block, block + 1)).otherwise(F.array(block))
    dealt = placed.withColumn("__own", block).withColumn("__block", F.explode(both))
    back = Window.partitionBy("__block").orderBy("__nth").rowsBetween(1 - window, 0)
    shared = dealt.withColumn(out, F.avg("__happened").over(back)).where("__block = __own")
    return shared.drop("__happened", "__nth", "__own", "__block")
