"""Intermediate tables on shared storage.

A job that reuses a result several times, or loops, writes it down and reads it back. That
cuts the lineage, survives the loss of executors (unlike cached or locally checkpointed
blocks) and gives the optimizer real file sizes to choose join strategies from.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from oligoloom.sources.shared import remove

_DIR_KEY = "spark.checkpoint.dir"


_local_dirs: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; only a local session may fall back to its own, which goes at exit."""
    configured = spark.conf.get(_DIR_KEY, None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {_DIR_KEY} to a folder that all executors share")
    if context.applicationId not in _local_dirs:
        folder = _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="oligoloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return _local_dirs[context.applicationId]


def materialize(rows: DataFrame, label: str) -> DataFrame:
    spark = rows.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    for written in _scopes:
        written.append(path)
    stored = spark.read.schema(rows.schema).parquet(path)
    _paths[stored] = path
    return stored


# Where the tables lie that are still referred to.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def is_stored(rows: DataFrame) -> bool:
    """Whether ``materialize`` returned this table and it is still there."""
    return rows in _paths


def discard(stored: DataFrame) -> None:
    """Remove a table that ``materialize`` returned; nothing may read it any more."""
    if stored in _paths:
        remove(stored.sparkSession, _paths.pop(stored))


_scopes: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that are written inside when it is left; nothing may read them any more then."""
    written: list[str] = []
    _scopes.append(written)
    try:
        yield
    finally:
        _scopes.remove(written)
        for path in written:
            remove(spark, path)
