"""Even distribution of work: row spreading and an equi-join that splits heavy keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from oligoloom.storage import materialize

# A key is heavy when its matches exceed this many; each grid cell then holds at most about that many.
CELL_MATCHES = 4_000_000
# Matches that one task of the join should get, and the most tasks it is cut into.
MATCHES_PER_TASK, MOST_TASKS = 4_000_000, 20_000
# Heavy keys are sent to every task up to this many; a longer list is joined like any other table.
BROADCAST_KEYS = 100_000

# Per-oligo work (k-mer sets, suffix keys) is heavy for the few bytes an oligo takes, so file
# splits are too coarse a unit for it.
ROWS_PER_TASK = 100_000
MIN_ROWS_PER_TASK = 500


def spread(rows: DataFrame, key: str, count: int) -> DataFrame:
    """Distribute ``count`` rows over enough tasks for row-wise work, by hash of a unique key."""
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = min(max(usual, math.ceil(count / ROWS_PER_TASK)), count // MIN_ROWS_PER_TASK)
    return rows.repartition(tasks, key) if tasks > 1 else rows


def heavy_keys(left: DataFrame, right: DataFrame, key: str, cell_matches: int) -> DataFrame:
    """(key, left parts, right parts) of all keys with more matches than a cell, from map-side combined counts."""
    return _heavy(_key_counts(left, right, key), key, cell_matches)


def _key_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    return (
        left.select(key, one.alias("l"), zero.alias("r"))
        .unionAll(right.select(key, zero.alias("l"), one.alias("r")))
        .groupBy(key)
        .agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    )


def _heavy(counts: DataFrame, key: str, cell_matches: float) -> DataFrame:
    side = math.sqrt(cell_matches)
    return (
        counts.where(F.col("l").cast("double") * F.col("r") > cell_matches)
        .select(
            key, F.ceil(F.col("l") / side).cast("int").alias("__lp"), F.ceil(F.col("r") / side).cast("int").alias("__rp")
        )
    )


def grid_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_id: str,
    right_id: str,
    condition: Column | None = None,
    cell_matches: int = CELL_MATCHES,
) -> DataFrame:
    """Inner join on ``key``. A heavy key becomes a grid: left rows pick a grid row by hash of
    their id and are copied along it, right rows do the same by column, so every pair still
    meets exactly once but no cell has more matches than one task should get. Both sides are stored first, so keys
    are worked out once for counting and joining. Every row of a heavy key is copied once for each cell along its row or column,
    so cells are no smaller than a task's share of all matches, up to MATCHES_PER_TASK: more of them only cost disk."""
    left, right = materialize(left, "left-keys"), materialize(right, "right-keys")
    seen = Observation()
    in_key = F.col("l").cast("double") * F.col("r")
    counts = _key_counts(left, right, key).observe(seen, F.sum(in_key).alias("matches"))
    counted = materialize(counts.where(in_key > cell_matches), "heavy-keys")
    matches, usual = seen.get["matches"] or 0, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = min(math.ceil(matches / MATCHES_PER_TASK), MOST_TASKS)
    heavy = _heavy(counted, key, max(cell_matches, min(MATCHES_PER_TASK, matches / usual)))
    grid = F.broadcast(heavy) if counted.count() <= BROADCAST_KEYS else heavy.hint("merge")

    def cell(row_id: str, parts: str) -> Column:
        return F.coalesce(F.pmod(F.xxhash64(row_id), F.col(parts)).cast("int"), F.lit(0))

    def copies(parts: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts), F.lit(1)) - 1))

    left_cells = (
        left.join(grid, key, "left")
        .withColumn("__i", cell(left_id, "__lp"))
        .withColumn("__j", copies("__rp"))
        .drop("__lp", "__rp")
    )
    right_cells = (
        right.join(grid, key, "left")
        .withColumn("__j", cell(right_id, "__rp"))
        .withColumn("__i", copies("__lp"))
        .drop("__lp", "__rp")
    )
    # Matches grow with the square of the rows, and so do the tasks beyond the usual number.
    if tasks > usual:
        left_cells, right_cells = (side.repartition(tasks, key, "__i", "__j") for side in (left_cells, right_cells))
    # Sizes after an explode are underestimated; neither side is ever broadcast.
    joined = left_cells.join(right_cells.hint("merge"), [key, "__i", "__j"]).drop("__i", "__j")
    return joined if condition is None else joined.where(condition)
