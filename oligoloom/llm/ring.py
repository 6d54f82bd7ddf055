"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``POINTS`` points; every shard sits on ``virtual_nodes`` of them, by hash. A document's key (its id and
the crc32 of its text, so that an id repeated over different texts spreads) falls on a point, and belongs to the
next virtual node clockwise. A shard's load is its number of rows and is bounded by its capacity: the rows divided
by the shards, rounded up for as many shards (the first in ring order) as there are rows left over, down for the
others. Rows that a full shard can't take continue clockwise, in rounds: in each round shards take what waits at
their virtual nodes, in ring order, until they are full; the rest moves on to the next virtual node of a shard with
room. The capacities add up to the rows, so every shard ends exactly full: counts are at most one apart.

Only counts by point take part in the rounds (at most ``POINTS`` numbers, whatever the table), since rows of one
point differ only in their rank there. Rows that are equal in all returned columns are counted together first, so
copies of one row never crowd a task.

Null texts have no bytes and the crc32 of nothing; null ids are keys of their own; repeated rows are dealt like
different ones. Other columns play no part. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict, deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POINTS = 1 << 14
ROW_BYTES = 8


def virtual_nodes(shards: int, each: int) -> list[tuple[int, int]]:
    """(point, shard) of all virtual nodes in ring order."""
    nodes = []
    for shard in range(shards):
        for copy in range(each):
            digest = hashlib.md5(f"{shard}/{copy}".encode()).hexdigest()
            nodes.append((int(digest[:8], 16) % POINTS, shard))
    return sorted(nodes)


def bounded_placement(
    counts: dict[int, int], nodes: list[tuple[int, int]], shards: int
) -> list[tuple[int, int, int, int, int]]:
    """(point, first rank, after last rank, shard, first slot): ranges of the rows of each point."""
    total = sum(counts.values())
    order = list(dict.fromkeys(shard for _, shard in nodes))
    room = {shard: total // shards + (i < total % shards) for i, shard in enumerate(order)}
    used = defaultdict(int)
    waiting: list[deque] = [deque() for _ in nodes]
    places = [point for point, _ in nodes]
    node = 0
    for point in sorted(counts):
        while node < len(nodes) and places[node] < point:
            node += 1
        waiting[node % len(nodes)].append((point, 0, counts[point]))
    placed = []
    while any(waiting):
        for at, (_, shard) in enumerate(nodes):
            while waiting[at] and room[shard]:
                point, first, after = waiting[at].popleft()
                taken = min(room[shard], after - first)
                placed.append((point, first, first + taken, shard, used[shard]))
                used[shard] += taken
                room[shard] -= taken
                if first + taken < after:
                    waiting[at].appendleft((point, first + taken, after))
        moved: list[deque] = [deque() for _ in nodes]
        for at in range(len(nodes)):
            if waiting[at]:
                onwards = ((at + step) % len(nodes) for step in range(1, len(nodes)))
                moved[next(to for to in onwards if room[nodes[to][1]])].extend(waiting[at])
        waiting = moved
    return placed


def shard_documents(
    docs: DataFrame, shards: int = 24, each: int = 64, doc: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; slots count each shard's rows from 0."""
    rows = docs.select(
        F.col(doc).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    keyed = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("rows"))
    key = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32")
    point = F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(POINTS))
    keyed = keyed.withColumn("point", point.cast("int"))
    counts = {r.point: r.n for r in keyed.groupBy("point").agg(F.sum("rows").alias("n")).collect()}
    placed = bounded_placement(counts, virtual_nodes(shards, each), shards) if counts else []
    ranges = docs.sparkSession.createDataFrame(
        placed, "point int, first long, after long, shard int, first_slot long"
    )
    # Ranks of a point's rows; rows that are the same count with their number.
    earlier = (
        Window.partitionBy("point").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    ranked = keyed.withColumn("rank", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    # At most one range for each point and one more for each time a shard gets full.
    met = ranked.join(F.broadcast(ranges), "point").where(
        (F.col("rank") < F.col("after")) & (F.col("rank") + F.col("rows") > F.col("first"))
    )
    begin = F.greatest("rank", "first")
    end = F.least(F.col("rank") + F.col("rows"), "after")
    slots = F.sequence(
        F.col("first_slot") + begin - F.col("first"), F.col("first_slot") + end - F.col("first") - 1
    )
    return met.select("doc_id", "size", "text_crc32", "shard", F.explode(slots).alias("slot"))
