"""A persistent index of the keys that oligos of a pool can be bound by.

The posting lists are a table: a row per oligo and end position with the key of its shortest hot suffix there (see
``conflicts.with_shortest_hot_suffix``), partitioned by batch and by a hash of the key. A batch is appended as a
folder of its own; removals are tombstones, folders of positions; compaction writes a new generation without what is
removed. Oligos that join later are always the right-hand side of a pair, so a batch works out its own right-hand
keys and probes the partitions that these fall into: nothing that is indexed is keyed again.

Every folder is written as a whole or overwritten when its batch is repeated, and a generation counts when its writer
has finished it, so a broken run finds what it had.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oligoloom.operators.conflicts import PairRules, conflicts_of_keys, left_keys, right_keys
from oligoloom.operators.skew import CELL_MATCHES
from oligoloom.sources.shared import exists, names, remove

POSTING_SCHEMA = "key long, left_index long, left_sequence string, left_last int, batch long, bucket int"
BUCKETS = 64


class KeyIndex:
    """``folder`` may be any URI that all executors reach; batches are numbered from 0."""

    def __init__(self, spark: SparkSession, folder: str, rules: PairRules, buckets: int = BUCKETS):
        self.spark, self.folder, self.rules, self.buckets = spark, folder, rules, buckets

    def _generation(self) -> int:
        found = [n for n in names(self.spark, self.folder) if n.startswith("generation-")]
        numbers = [int(n.removeprefix("generation-")) for n in found]
        whole = [n for n in numbers if exists(self.spark, f"{self.folder}/generation-{n}/postings/batch=-1/_SUCCESS")]
        return max(whole, default=0)

    def _path(self, kind: str) -> str:
        return f"{self.folder}/generation-{self._generation()}/{kind}"

    def _bucketed(self, keys: DataFrame) -> DataFrame:
        return keys.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int"))

    def append(self, pool: DataFrame, batch: int, seq: str = "sequence", order: str = "idx") -> None:
        """Index the oligos of a batch."""
        keys = self._bucketed(left_keys(pool, self.rules, seq, order))
        rows = keys.select("key", "left_index", "left_sequence", "left_last", "bucket").repartition("bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self._path('postings')}/batch={batch}")

    def remove(self, gone: DataFrame, batch: int, order: str = "idx") -> None:
        """Note that oligos of the pool are gone; their postings stay until the next compaction."""
        rows = gone.select(F.col(order).cast("long").alias("left_index"))
        rows.write.mode("overwrite").parquet(f"{self._path('removed')}/batch={batch}")

    def _read(self, kind: str, schema: str) -> DataFrame:
        path = self._path(kind)
        batches = [n for n in names(self.spark, path) if n.startswith("batch=")]
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/{n}" for n in batches])

    def postings(self, through: int | None = None) -> DataFrame:
        """The postings of all batches up to ``through``, without removed oligos."""
        rows, gone = self._read("postings", POSTING_SCHEMA), self._read("removed", "left_index long, batch long")
        if through is not None:
            rows, gone = (frame.where(F.col("batch") <= through) for frame in (rows, gone))
        return rows.join(gone.select("left_index").distinct(), "left_index", "left_anti")

    def conflicts(
        self,
        new: DataFrame,
        through: int | None = None,
        seq: str = "sequence",
        order: str = "idx",
        cell_matches: int = CELL_MATCHES,
    ) -> DataFrame:
        """Conflicts of new oligos with earlier ones of the index (see ``conflicts.conflict_edges``)."""
        probes = self._bucketed(right_keys(new, self.rules, seq, order))
        # Only what shares a key with the batch leaves the index; the scan skips partitions without its keys.
        wanted = probes.select("bucket", "key").distinct()
        met = self.postings(through).join(wanted, ["bucket", "key"], "left_semi")
        return conflicts_of_keys(met.drop("batch", "bucket"), probes.drop("bucket"), self.rules, cell_matches)

    def compact(self) -> None:
        """One batch without removed oligos in place of all; later batches are appended to it."""
        old = self._generation()
        rows = self.postings().select("key", "left_index", "left_sequence", "left_last", "bucket").repartition("bucket")
        fresh = f"{self.folder}/generation-{old + 1}/postings/batch=-1"
        rows.write.mode("overwrite").partitionBy("bucket").parquet(fresh)
        remove(self.spark, f"{self.folder}/generation-{old}")
