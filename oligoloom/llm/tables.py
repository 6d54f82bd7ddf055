"""Stored intermediate tables of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oligoloom.storage import scratch_dir


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def own_names(rows: DataFrame, *names: str) -> list[str]:
    """Names for columns of an operator's own, ``__name`` or with more underscores where the table has such columns."""
    prefix = "__"
    while any(column.lower().startswith(prefix) for column in rows.columns):
        prefix += "_"
    return [prefix + name for name in names]


def stored(rows: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write the rows to shared storage and read them back: lineage is cut, lost executors cost nothing."""
    path = scratch_path(rows.sparkSession, label)
    rows.write.option("compression", compression).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


# Rows of one key that a task can take without standing out.
COMMON_ROWS = 1000
_MOST_COMMON = 10_000


def common_keys(rows: DataFrame, key: str) -> DataFrame:
    """The keys with more than ``COMMON_ROWS`` rows and a ten-thousandth of all rows, so never more than 10,000."""
    counts = stored(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")), "key-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return stored(counts.where(F.col("n") > max(COMMON_ROWS, total // _MOST_COMMON)).select(key), "common-keys")


def lookup(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Left join to ``values``, which has every key once. Rows of common keys stay where they are and get their
    values by broadcast (at most 10,000). ``rows`` should be a stored table: it is read several times."""
    common = common_keys(rows, key)
    if common.isEmpty():
        return rows.join(values, key, "left")
    common = F.broadcast(common)
    hot = rows.join(common, key, "left_semi").join(F.broadcast(values.join(common, key, "left_semi")), key, "left")
    return hot.unionByName(rows.join(common, key, "left_anti").join(values, key, "left"))
