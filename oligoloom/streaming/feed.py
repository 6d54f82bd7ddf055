"""A pool that grows with a stream of candidates.

Each micro-batch is filtered, freed of sequences the pool already has, appended, and validated
against the pool through its key index: only the batch is keyed and only pairs with a new member
are scored. Results go to one folder per batch and only earlier batches are read, so a batch that
is repeated after a failure overwrites its own output and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from oligoloom.operators.accept import with_position
from oligoloom.operators.conflicts import PairRules
from oligoloom.operators.funnel import FunnelSettings, survivors, with_reason
from oligoloom.operators.key_index import KeyIndex
from oligoloom.storage import scratch_scope

POOL_SCHEMA = "attempt_id long, sequence string, intrinsic_tm_c double, idx long, batch long"


def judge(candidates: DataFrame, settings: FunnelSettings) -> DataFrame:
    """Funnel verdict of each proposal of a stream. Repeats get the same verdict again: telling them apart would
    take a state as large as the stream; the growing pool finds them in its own table."""
    return with_reason(candidates, settings)


def read_pool(rows: DataFrame, folder: str, before: int | None = None) -> DataFrame:
    """The pool in ``folder``, optionally as it was before a batch."""
    pool = rows.sparkSession.read.schema(POOL_SCHEMA).parquet(f"{folder}/pool")
    return pool if before is None else pool.where(F.col("batch") < before)


def grow_pool(
    candidates: DataFrame, settings: FunnelSettings, rules: PairRules, folder: str
) -> DataStreamWriter:
    """Writer that maintains ``folder``/pool, /index and /edges; the caller sets the trigger."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # Create the table once so that the first read finds it.
        empty = spark.createDataFrame([], POOL_SCHEMA)
        empty.drop("batch").write.mode("overwrite").parquet(f"{folder}/pool/batch=-1")
        earlier = read_pool(batch, folder, batch_id)
        size = earlier.count()
        fresh = survivors(batch, settings).join(earlier.select("sequence"), "sequence", "left_anti")
        with scratch_scope(spark):
            numbered = with_position(fresh, "attempt_id").withColumn("idx", F.col("idx") + size)
            numbered = numbered.select("attempt_id", "sequence", "intrinsic_tm_c", "idx")
            numbered.write.mode("overwrite").parquet(f"{folder}/pool/batch={batch_id}")
            fresh = read_pool(batch, folder, batch_id + 1).where(F.col("batch") == batch_id)
            index = KeyIndex(spark, f"{folder}/index", rules)
            index.append(fresh, batch_id)
            edges = index.conflicts(fresh, through=batch_id)
            edges.write.mode("overwrite").parquet(f"{folder}/edges/batch={batch_id}")

    return candidates.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/offsets")
