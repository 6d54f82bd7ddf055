"""Longest-prefix URL rules by a sort-merge range join.

A host becomes a key by reversing its labels, each closed by a dot: ``www.example.net`` gives ``net.example.www.``.
A rule fits its host and all subdomains, so its host is a prefix of their keys: an interval of the sorted keys, and
intervals of different hosts nest or are disjoint. Keys of rules and urls are dealt into the same ranges, a rule
into every range its interval touches; each range is sorted and swept once, with the nested rules that are active
kept on a stack. Of the active rules whose path starts the url's path the longest wins: the longer host, then the
longer path. A host with very many urls fills several ranges of its own: keys are followed by a hash of the url.

Null urls and urls without ``://`` have an empty host and path; only a rule without a host fits them (if its path
is empty as well). Null rules' hosts and paths count as empty; of equal rules the smallest verdict wins. Repeated
rows are judged alike; other columns of the pages play no part; an empty table gives no rows, no rules give the
default verdict to all.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Urls to a range; sampled keys for each range border.
RANGE_ROWS = 200_000
SAMPLES_PER_RANGE = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LAST = "\U0010ffff"


def _host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end; then up to ``?``, ``#`` or the end."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    """Labels reversed, each closed by a dot; the empty host is the empty key."""
    reversed_labels = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))
    return F.when(host == "", F.lit("")).otherwise(reversed_labels)


class Sweep:
    """Rules and keys in rising order; the stack holds the rules whose interval the sweep is in."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, list[tuple[str, str, str]]]] = []

    def advance(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def enter(self, prefix: str, path: str, name: str, verdict: str) -> None:
        self.advance(prefix)
        if not self.stack or self.stack[-1][0] != prefix:
            self.stack.append((prefix, []))
        self.stack[-1][1].append((path, name, verdict))

    def judge(self, key: str, path: str) -> tuple[str, str] | None:
        self.advance(key)
        for _, rules in reversed(self.stack):
            fitting = [r for r in rules if path.startswith(r[0])]
            if fitting:
                _, name, verdict = min(fitting, key=lambda r: (-len(r[0]), r[2]))
                return name, verdict
        return None


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    default: str = "allow",
    page: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; ``rules``: (host, path, verdict)."""
    host, path = _host_and_path(F.col("__url"))
    urls = pages.select(F.col(page).alias("page_id"), F.col(url).cast("string").alias("__url"))
    urls = urls.select("page_id", host.alias("host"), path.alias("path"), F.xxhash64("page_id", "__url").alias("salt"))
    urls = urls.withColumn("key", host_key(F.col("host")))
    given = rules.select(
        F.translate(F.coalesce(F.col("host"), F.lit("")), _UPPER, _LOWER).alias("host"),
        F.coalesce(F.col("path"), F.lit("")).alias("path"),
        F.col("verdict").cast("string").alias("verdict"),
    ).withColumn("key", host_key(F.col("host")))

    # Range borders from a sample whose size follows the number of ranges, not the table.
    total = urls.count()
    usual = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, -(-total // RANGE_ROWS), min(usual, total))
    wanted = ranges * SAMPLES_PER_RANGE
    sample = urls.select("key", "salt")
    if total > wanted:
        sample = sample.where(F.pmod(F.xxhash64("salt"), F.lit(max(1, total // wanted))) == 0)
    drawn = sorted((r.key, r.salt) for r in sample.collect())
    borders = sorted({drawn[len(drawn) * i // ranges] for i in range(1, ranges)}) if drawn else []

    @F.pandas_udf("int")
    def range_of(key: pd.Series, salt: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(borders, x) for x in zip(key, salt)], dtype="int32")

    low, high = F.lit(-(1 << 63)).cast("long"), F.lit((1 << 63) - 1).cast("long")
    starts = given.withColumn(
        "range", F.explode(F.sequence(range_of("key", low), range_of(F.concat("key", F.lit(_LAST)), high)))
    ).select(
        "range", "key", F.lit(0).alias("kind"), low.alias("salt"), F.lit(None).cast("long").alias("page_id"),
        "host", "path", "verdict",
    )
    points = urls.select(
        range_of("key", "salt").alias("range"), "key", F.lit(1).alias("kind"), "salt", "page_id", "host", "path",
        F.lit(None).cast("string").alias("verdict"),
    )

    kinds = [pa.int64(), *[pa.string()] * 4]
    names = ["page_id", "host", "path", "rule", "verdict"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, current = Sweep(), None
        for batch in batches:
            out: list[tuple] = []
            for place, key, kind, page_id, host, path, verdict in zip(*(c.to_pylist() for c in batch.columns)):
                if place != current:
                    sweep, current = Sweep(), place
                if kind == 0:
                    sweep.enter(key, path, host + path, verdict)
                else:
                    out.append((page_id, host, path, *(sweep.judge(key, path) or (None, default))))
            columns = zip(*out) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=names)

    swept = starts.unionByName(points).repartition(ranges, "range").sortWithinPartitions("range", "key", "kind", "salt")
    swept = swept.select("range", "key", "kind", "page_id", "host", "path", "verdict")
    return swept.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
