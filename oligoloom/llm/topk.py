"""Exact top-k search by inner product, without random access.

Every dimension is a list of the candidates sorted by their component, cut into ``LEVELS`` runs of equal length.
A query reads the lists of its positive weights from the largest component down and those of its negative
weights from the smallest up, all lists run by run. What a run shows is added to the scores of its candidates; for
what is not read the list's last read value bounds the component on one side and the list's end on the other. So
each candidate has a lower and an upper bound. The k-th largest lower bound is the mark: reading stops for a
candidate whose upper bound is below it, and for a query when no candidate outside its best k can reach it; runs
behind that stay unread. The candidates that are left over for a query, and no others, get their final scores.

Candidates lie in blocks of ``BLOCK_ROWS`` vectors and queries in blocks of ``QUERY_ROWS``; each pair of blocks is
one piece of work with bounds for all its queries at once, and the best k of the blocks are merged. The stated
queries meet every block by an equi-join on block numbers.

Components are floor(scale * x), at any size. Where sums may need more than 53 bits, bounds are worked out on values
divided by the largest ones and widened by more than their rounding error, and final scores in whole numbers; scores
beyond a long count as the nearest long. Vectors that are null, or hold null or non-finite components (also after
scaling), and rows without an id take no part. Vectors of different lengths are not compared; empty vectors score 0. A
query meets no row of its own id. Repeated ids stay separate candidates and separate queries. Fewer candidates than k
give them all, none give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oligoloom.llm.tables import stored

BLOCK_ROWS, QUERY_ROWS = 8192, 1024
# Queries of a block whose bounds are held at once.
QUERY_STRIP = 128
LEVELS = 4
_EXACT = 1 << 53
_LONG = (1 << 63) - 1


def scaled_vectors(vectors: DataFrame, scale: float, vec: str = "vec_id", values: str = "embedding") -> DataFrame:
    """(vec_id, v): whole components, as doubles, of the vectors that take part."""

    def whole(x: Column) -> Column:
        scaled = x.cast("double") * scale
        # Larger doubles are whole numbers already.
        return F.when(F.abs(scaled) < float(_EXACT), F.floor(scaled).cast("double")).otherwise(scaled)

    def fine(x: Column) -> Column:
        scaled = x.cast("double") * scale
        return x.isNotNull() & ~F.isnan(scaled) & (F.abs(scaled) < float("inf"))

    known = F.col(vec).isNotNull() & F.col(values).isNotNull() & F.forall(F.col(values), fine)
    return vectors.where(known).select(F.col(vec).cast("long").alias("vec_id"), F.transform(values, whole).alias("v"))


def blocks(rows: DataFrame, size: int, count: int) -> DataFrame:
    """(block, dims, ids, data): rows dealt evenly into blocks of about ``size`` vectors of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            column = batch.column(1)
            lengths = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy()
            ends = np.cumsum(lengths)
            for dims in np.unique(lengths).tolist():
                mine = np.flatnonzero(lengths == dims)
                data = flat[(ends[mine] - dims)[:, None] + np.arange(dims)[None, :]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([dims], pa.int32()),
                        pa.array([len(mine)], pa.int32()),
                        pa.array([ids[mine].astype("<i8").tobytes()], pa.binary()),
                        pa.array([data.astype("<f8").tobytes()], pa.binary()),
                    ],
                    names=["dims", "n", "ids", "data"],
                )

    # An even deal of the rows, each partition one block (or one for each vector length).
    dealt = rows.repartition(max(1, -(-count // size)))
    packed = dealt.mapInArrow(run, "dims int, n int, ids binary, data binary")
    return packed.withColumn("block", F.monotonically_increasing_id())


class Lists:
    """The sorted lists of one block of candidates."""

    def __init__(self, ids: np.ndarray, data: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.data = ids[order], data[order]
        self.rising = np.argsort(self.data, axis=0, kind="stable")
        self.cuts = [(len(ids) * level) // LEVELS for level in range(LEVELS + 1)]

    def run(self, level: int, from_top: bool) -> tuple[np.ndarray, np.ndarray]:
        """(candidates, values) that this run of every list shows, a column for each list."""
        first, last = self.cuts[level], self.cuts[level + 1]
        if from_top:
            first, last = len(self.ids) - last, len(self.ids) - first
        shown = self.rising[first:last]
        return shown, np.take_along_axis(self.data, shown, axis=0)


class Reading:
    """Bounds of the scores of some queries while the lists are read; ``scale`` keeps products small."""

    def __init__(self, lists: Lists, weights: np.ndarray, kind: type, scale: tuple[float, float]):
        self.lists, self.kind, self.scale = lists, kind, scale[1]
        plus = np.maximum(weights, 0) / scale[0]
        self.weights = {True: plus.astype(kind), False: (weights / scale[0] - plus).astype(kind)}
        shape = (weights.shape[1], len(lists.ids))
        self.score = np.zeros((len(weights), len(lists.ids)), dtype=kind)
        self.unread = {True: np.ones(shape, dtype=kind), False: np.ones(shape, dtype=kind)}
        ends = [np.take_along_axis(lists.data, lists.rising[[at]], axis=0)[0] for at in (0, -1)]
        self.far_end = {True: (ends[0] / self.scale).astype(kind), False: (ends[1] / self.scale).astype(kind)}

    def read(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Read the next run of every list from both sides; (queries, candidates) lower and upper bounds."""
        lower, upper = np.zeros_like(self.score), np.zeros_like(self.score)
        for from_top, weights in self.weights.items():
            shown, values = self.lists.run(level, from_top)
            values = (values / self.scale).astype(self.kind)
            seen = np.zeros_like(self.unread[from_top])
            np.put_along_axis(seen, shown.T, values.T, axis=1)
            self.score += weights @ seen
            unread = self.unread[from_top]
            np.put_along_axis(unread, shown.T, 0, axis=1)
            # The last value shown: the first row of a run from the top, the last one from the bottom.
            last = values[0 if from_top else -1] if len(values) else self.far_end[not from_top]
            upper += weights @ (unread * last[:, None])
            lower += weights @ (unread * self.far_end[from_top][:, None])
        return self.score + lower, self.score + upper


def _whole_numbers(values: np.ndarray) -> np.ndarray:
    return np.array([int(x) for x in values.ravel()], dtype=object).reshape(values.shape)


def _final_scores(weights: np.ndarray, vectors: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (vectors.astype(np.float64) @ weights.astype(np.float64)).astype(np.int64)
    sums = _whole_numbers(vectors) @ _whole_numbers(weights) if vectors.size else np.zeros(len(vectors), dtype=object)
    return np.array([max(-_LONG - 1, min(_LONG, int(x))) for x in sums], dtype=np.int64)


def search_block(
    query_ids: np.ndarray, queries: np.ndarray, lists: Lists, k: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(query numbers, query ids, candidate ids, scores): the k best candidates of the block for each query."""
    dims = queries.shape[1]
    for first in range(0, len(queries), QUERY_STRIP):
        ids, weights = query_ids[first : first + QUERY_STRIP], queries[first : first + QUERY_STRIP]
        largest = [float(np.abs(x).max(initial=0)) for x in (weights, lists.data)]
        # Floats are exact as long as every sum fits their digits.
        most = int(largest[0]) * int(largest[1]) * max(1, dims)
        exact = most < _EXACT
        kind, scale, slack = np.float32 if most < 1 << 24 else np.float64, (1.0, 1.0), 0.0
        if not exact:
            scale, slack = (largest[0], largest[1]), 8.0 * (dims + 1) ** 2 * np.finfo(np.float64).eps
        needed = ids[:, None] != lists.ids[None, :]
        if len(lists.ids) > k and dims:
            reading = Reading(lists, weights, kind, scale)
            for level in range(LEVELS):
                lower, upper = reading.read(level)
                lower = np.where(needed, lower, -np.inf)
                mark = np.partition(lower, lower.shape[1] - k, axis=1)[:, lower.shape[1] - k]
                if not exact:
                    # All scores beyond a long are the nearest long, and so equal.
                    end = _LONG / scale[0] / scale[1]
                    mark = np.where(mark > end, end, np.where(mark < -end, -np.inf, mark))
                needed &= upper >= mark[:, None] - slack
                if (needed.sum(axis=1) <= k).all():
                    break
        for q in range(len(ids)):
            mine = np.flatnonzero(needed[q])
            scores = _final_scores(weights[q], lists.data[mine], exact)
            # Candidates lie in the order of their ids, so a stable sort keeps the smaller id first.
            best = np.argsort(~scores, kind="stable")[:k]
            mine, scores = mine[best], scores[best]
            yield np.full(len(mine), first + q), np.full(len(mine), ids[q]), lists.ids[mine], scores


_FOUND = "q_block long, q_number long, query_id long, vec_id long, score long"


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    scale: float = 64.0,
    vec: str = "vec_id",
    values: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of every query, ties to the smaller id."""
    rows = stored(scaled_vectors(vectors.select(vec, values), scale, vec, values), "scaled-vectors")
    asked = rows.where(is_query)
    n, m = rows.count(), asked.count()
    candidates = stored(blocks(rows, BLOCK_ROWS, n), "candidate-blocks")
    queries = stored(blocks(asked, QUERY_ROWS, m), "query-blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shape = (-1, row["dims"]) if row["dims"] else (row["n"], 0)
                lists = Lists(np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["data"], "<f8").reshape(shape))
                q_shape = (-1, row["dims"]) if row["dims"] else (row["q_n"], 0)
                q_ids = np.frombuffer(row["q_ids"], "<i8")
                q_data = np.frombuffer(row["q_data"], "<f8").reshape(q_shape)
                found = list(search_block(q_ids, q_data, lists, k))
                columns = [np.concatenate(x).astype(np.int64) for x in zip(*found)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (np.full(len(columns[0]), row["q_block"]), *columns)],
                    names=["q_block", "q_number", "query_id", "vec_id", "score"],
                )

    numbers = queries.select(F.col("block").alias("q_block"), F.col("dims").alias("q_dims"))
    # One row for each pair of blocks, by the length of their vectors; blocks carry thousands of rows each.
    plan = candidates.select("block", "dims").join(numbers, F.col("dims") == F.col("q_dims")).select("block", "q_block")
    tasks = max(1, -(-n // BLOCK_ROWS) * -(-m // QUERY_ROWS))
    work = (
        plan.join(candidates, "block")
        .join(
            queries.select(
                F.col("block").alias("q_block"),
                F.col("n").alias("q_n"),
                F.col("ids").alias("q_ids"),
                F.col("data").alias("q_data"),
            ),
            "q_block",
        )
        .repartition(tasks, "block", "q_block")
    )
    best = Window.partitionBy("q_block", "q_number").orderBy(F.desc("score"), "vec_id")
    return (
        work.mapInArrow(run, _FOUND)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
