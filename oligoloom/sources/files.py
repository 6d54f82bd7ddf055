"""Run directories, sinks and the resumable state of a run."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oligoloom.config import ConfigError, RunConfig
from oligoloom.functions.sequence import is_dna
from oligoloom.sources.shared import exists, make_folder, names, read_text, remove, write_text

LATEST = "latest_run.txt"


def read_candidates(spark: SparkSession, path: str, length: int, format: str = "parquet", **options) -> DataFrame:
    """External candidates (attempt_id, sequence); anything but DNA of this length fails the job."""
    rows = spark.read.format(format).options(**options).load(path)
    text = F.upper(F.col("sequence"))
    checked = F.when(is_dna(text, length), text).otherwise(
        F.raise_error(F.concat(F.lit(f"not a {length}-base sequence: "), F.coalesce(text, F.lit("null"))))
    )
    return rows.select(F.col("attempt_id").cast("long").alias("attempt_id"), checked.alias("sequence"))


def output_root(config: RunConfig) -> str:
    """Where run directories go: a URI as given, or a folder next to the configuration."""
    root = str(config.output.root_dir)
    return root.rstrip("/") if ":" in root else str((config.base_dir / root).resolve())


def new_run_dir(spark: SparkSession, config: RunConfig, suffix: str = "", remember: bool = True) -> str:
    root = output_root(config)
    stamp = datetime.now().strftime("%Y%m%d_%H%M%S") + suffix
    for number in range(1, 10_000):
        run_dir = f"{root}/{stamp}" if number == 1 else f"{root}/{stamp}_{number:02d}"
        if exists(spark, run_dir):
            continue
        make_folder(spark, run_dir)
        if remember:
            write_text(spark, f"{root}/{LATEST}", run_dir)
        return run_dir
    raise ConfigError(f"no free run directory under {root}")


def latest_run_dir(spark: SparkSession, config: RunConfig) -> str:
    pointer = f"{output_root(config)}/{LATEST}"
    if not exists(spark, pointer):
        raise ConfigError(f"no earlier run is recorded in {pointer}")
    run_dir = read_text(spark, pointer).strip()
    if not exists(spark, run_dir):
        raise ConfigError(f"the recorded run directory is gone: {run_dir}")
    return run_dir


def python_float(value: Column) -> Column:
    """Infinities the way CSV readers outside the JVM spell them."""
    return (
        F.when(value == float("-inf"), F.lit("-inf"))
        .when(value == float("inf"), F.lit("inf"))
        .otherwise(value.cast("string"))
    )


def write_csv(rows: DataFrame, path: str, order: str, count: int) -> None:
    """A CSV folder of part files in ``order``; without rows it has no header line either."""
    rows = rows.orderBy(order)
    doubles = [f.name for f in rows.schema.fields if f.dataType.simpleString() == "double"]
    columns = [python_float(F.col(c)).alias(c) if c in doubles else F.col(c) for c in rows.columns if c != order]
    rows.select(*columns).write.mode("overwrite").csv(path, header=count > 0)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_json(spark: SparkSession, path: str, payload: dict[str, Any]) -> None:
    write_text(spark, path, json.dumps(payload, indent=2, sort_keys=True))


def write_yaml(spark: SparkSession, path: str, payload: dict[str, Any]) -> None:
    write_text(spark, path, yaml.safe_dump(payload, sort_keys=False, default_flow_style=False))


POOL_SCHEMA = "idx long, attempt_id long, sequence string, intrinsic_tm_c double"
SEEN_SCHEMA = "sequence string"
JUDGED_SCHEMA = "sequence string, reason string"


@dataclass
class RunState:
    """What a run needs to go on: the accepted pool, every sequence ever accepted, the verdicts of all attempts.

    These are tables that grow by a folder a batch; a manifest lists the folders. Every save writes
    a manifest of its own, last of all, and then removes earlier ones: the newest that is there counts, so a save that
    breaks off anywhere leaves the old state or the new one, and a repeated batch overwrites its own folder.
    """

    spark: SparkSession
    folder: str
    config: RunConfig
    seed: int
    attempts: int = 0
    version: int = 0
    pool_parts: list[str] = field(default_factory=list)
    seen_parts: list[str] = field(default_factory=list)
    judged_parts: list[str] = field(default_factory=list)

    def _table(self, parts: list[str], schema: str) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{part}" for part in parts])

    @property
    def pool(self) -> DataFrame:
        return self._table(self.pool_parts, POOL_SCHEMA)

    @property
    def seen(self) -> DataFrame:
        return self._table(self.seen_parts, SEEN_SCHEMA)

    @property
    def judged(self) -> DataFrame:
        return self._table(self.judged_parts, JUDGED_SCHEMA)

    def _write(self, rows: DataFrame, name: str) -> str:
        part = f"{name}-{self.version + 1}"
        rows.write.mode("overwrite").parquet(f"{self.folder}/{part}")
        return part

    def append(self, rows: DataFrame, attempts: int, verdicts: DataFrame) -> None:
        """Add newly accepted rows, and the attempts they took with their verdicts."""
        columns = [c.split()[0] for c in POOL_SCHEMA.split(", ")]
        self.pool_parts = [*self.pool_parts, self._write(rows.select(columns), "pool")]
        self.seen_parts = [*self.seen_parts, self._write(rows.select("sequence"), "seen")]
        self.judged_parts = [*self.judged_parts, self._write(verdicts.select("sequence", "reason"), "judged")]
        self.attempts = attempts
        self._save()

    def replace_pool(self, rows: DataFrame) -> None:
        self.pool_parts = [self._write(rows, "pool")]
        self._save()

    def _save(self) -> None:
        self.version += 1
        manifest = {
            "pool": self.pool_parts,
            "seen": self.seen_parts,
            "judged": self.judged_parts,
            "version": self.version,
            "attempts": self.attempts,
            "seed": self.seed,
            "config_digest": self.config.digest,
            "config": self.config.merged,
        }
        earlier = manifests(self.spark, self.folder)
        write_text(self.spark, f"{self.folder}/manifest-{self.version:09d}.json", json.dumps(manifest, default=str))
        for name in earlier:
            remove(self.spark, f"{self.folder}/{name}")


def manifests(spark: SparkSession, folder: str) -> list[str]:
    """Names of complete manifests, the newest last; drafts have another ending."""
    return [n for n in names(spark, folder) if n.startswith("manifest-") and n.endswith(".json")]


def load_state(spark: SparkSession, folder: str, config: RunConfig) -> RunState:
    found = manifests(spark, folder)
    if not found:
        raise ConfigError(f"no checkpoint in {folder}")
    manifest = json.loads(read_text(spark, f"{folder}/{found[-1]}"))
    same = json.loads(json.dumps(config.merged, default=str)) == manifest["config"]
    if manifest["config_digest"] != config.digest and not same:
        raise ConfigError("the checkpoint was written under a different configuration")
    return RunState(
        spark,
        folder,
        config,
        seed=manifest["seed"],
        attempts=manifest["attempts"],
        version=manifest["version"],
        pool_parts=manifest["pool"],
        seen_parts=manifest["seen"],
        judged_parts=manifest["judged"],
    )
