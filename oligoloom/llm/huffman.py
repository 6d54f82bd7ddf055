"""Token ids in a compact file: canonical Huffman codes of limited length, decoded by table.

File format (a folder of two Parquet tables, so Spark splits, writes and recovers it):

* ``code``: one row per used id with its code length. Codes are canonical: ordered by length, then id.
* ``segments``: whole documents in ascending document order, at least ``SEGMENT_IDS`` ids to a row:
  ``part`` and ``segment`` (their order is the order of the documents), ``before`` (ids before it in the
  part), ``doc_ids``, ``sizes`` (ids of each document), ``checkpoints`` (bit offset of every
  ``BLOCK_IDS``-th id; each block is decoded on its own), ``payload`` (bits, most significant first).

Ids are counted over all documents before coding. Null texts count as empty (a lone end id), null document
ids sort first, repeated ids and rows are all kept, in order of length and content among themselves.
Columns other than the two named ones play no part. No documents give an empty file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oligoloom.llm.bytesets import slices
from oligoloom.llm.tables import stored
from oligoloom.llm.tokens import ENCODE_BYTES, encoder, with_end

BLOCK_IDS = 1024
SEGMENT_IDS = 1 << 16
# Ids to a range of documents, which one task sorts and codes.
PART_IDS = 4 << 20
# A decoding table has 2 ** limit entries; peeking at 32 bits leaves room for 25.
MAX_LIMIT = 25


def token_table(docs: DataFrame, tokenizer: str, end_id: int, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n, ids): every whole text's ids with the end id, as little-endian unsigned integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch.column(1), ENCODE_BYTES):
                ids, before = with_end(*coder.encode(part), end_id)
                small = ids.astype("<u2") if end_id < 1 << 16 and ids.max(initial=0) < 1 << 16 else ids.astype("<u4")
                width = small.dtype.itemsize
                offsets = pa.py_buffer((before * width).astype(np.int32))
                blobs = pa.Array.from_buffers(pa.binary(), len(part), [None, offsets, pa.py_buffer(small)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.first, len(part)),
                        pa.array(np.diff(before)),
                        pa.array(np.full(len(part), width, dtype=np.int32)),
                        blobs,
                    ],
                    names=["doc", "n", "width", "ids"],
                )

    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc long, n long, width int, ids binary")


def ids_of(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(blob, dtype="<u2" if width == 2 else "<u4").astype(np.int64)


def id_counts(tokens: DataFrame) -> DataFrame:
    """(id, count) over all documents; counted in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            for blob, width in zip(batch.column(1), batch.column(0).to_numpy()):
                some = np.bincount(ids_of(blob.as_buffer(), width))
                if len(some) > len(counts):
                    counts = np.concatenate([counts, np.zeros(len(some), dtype=np.int64)])
                counts[: len(some)] += some
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["id", "count"])

    counted = tokens.select("width", "ids").mapInArrow(run, "id long, count long")
    return counted.groupBy("id").agg(F.sum("count").alias("count"))


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive counts, by merging packages."""
    symbols = len(counts)
    if symbols <= 1:
        return np.ones(symbols, dtype=np.int64)
    if symbols > 1 << limit:
        raise ValueError(f"{symbols} ids don't fit codes of {limit} bits")
    order = np.argsort(counts, kind="stable")
    weights = counts[order].astype(np.int64)
    merged, levels = np.zeros(0, dtype=np.int64), []
    for _ in range(limit):
        pairs = len(merged) // 2
        both = np.concatenate([weights, merged[0 : 2 * pairs : 2] + merged[1 : 2 * pairs : 2]])
        place = np.argsort(both, kind="stable")
        levels.append(place < symbols)
        merged = both[place]
    lengths, wanted = np.zeros(symbols, dtype=np.int64), 2 * symbols - 2
    for single in reversed(levels):
        taken = int(single[:wanted].sum())
        lengths[:taken] += 1
        wanted = 2 * (wanted - taken)
    out = np.zeros(symbols, dtype=np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical code of ``ids`` (ascending) with the given lengths."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        self.limit = int(lengths.max(initial=1))
        order = np.lexsort((ids, lengths))
        steps = np.left_shift(1, self.limit - lengths[order])
        first = np.cumsum(steps) - steps  # code, filled up to ``limit`` bits
        size = int(ids.max(initial=-1)) + 1
        self.length = np.zeros(size, dtype=np.int64)
        self.word = np.zeros(size, dtype=np.uint64)
        self.length[ids] = lengths
        self.word[ids[order]] = (first >> (self.limit - lengths[order])).astype(np.uint64)
        # Id and length in one number, 32 bits wide where they fit, to keep the table close to the processor.
        entries = ids[order] << 5 | lengths[order]
        self.table = np.zeros(1 << self.limit, dtype=np.int32 if entries.max(initial=0) < 1 << 31 else np.int64)
        filled = np.repeat(entries, steps)
        self.table[: len(filled)] = filled

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Payload and the bit offset of every block."""
        length = self.length[ids]
        end = np.cumsum(length)
        begin = end - length
        if len(ids) == 0:
            return b"", begin
        place, bit = begin >> 6, begin & 63
        over = bit + length - 64
        word = self.word[ids]
        fits = over <= 0
        head = np.where(
            fits, word << np.where(fits, -over, 0).astype(np.uint64), word >> np.where(fits, 0, over).astype(np.uint64)
        )
        out = np.zeros(int(end[-1] >> 6) + 2, dtype=np.uint64)
        firsts = np.flatnonzero(np.diff(place, prepend=-1))
        out[place[firsts]] = np.bitwise_or.reduceat(head, firsts)
        spilled = np.flatnonzero(~fits)
        out[place[spilled] + 1] |= word[spilled] << (64 - over[spilled]).astype(np.uint64)
        return out.byteswap().tobytes()[: int(end[-1] + 7) // 8], begin[::BLOCK_IDS]

    def decode(self, payloads: list[bytes], checkpoints: list[np.ndarray], sizes: list[int]) -> list[np.ndarray]:
        """Ids of several payloads; all their blocks advance together, one id of each at a step."""
        place = np.cumsum([0, *(len(p) for p in payloads)])
        raw = np.frombuffer(b"".join([*payloads, bytes(8)]), dtype=np.uint8).astype(np.uint32)
        peeked = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        cursor = np.concatenate([at * 8 + np.asarray(c, dtype=np.int64) for at, c in zip(place, checkpoints)])
        left = [np.minimum(BLOCK_IDS, n - BLOCK_IDS * np.arange(len(c))) for c, n in zip(checkpoints, sizes)]
        count = np.concatenate(left).astype(np.int64)
        order = np.argsort(-count, kind="stable")
        cursor, shorter = cursor[order], np.sort(count)
        out = np.zeros((len(order), BLOCK_IDS), dtype=np.int32)
        drop = 32 - self.limit
        mask = (1 << self.limit) - 1
        for step in range(int(count.max(initial=0))):
            alive = len(order) - int(np.searchsorted(shorter, step, side="right"))
            at = cursor[:alive]
            entry = self.table[peeked[at >> 3].astype(np.int64) >> (drop - (at & 7)) & mask]
            out[:alive, step] = entry >> 5
            cursor[:alive] += entry & 31
        back = np.zeros_like(out)
        back[order] = out
        ends = np.cumsum([0, *(len(c) for c in checkpoints)])
        return [back[a:b].reshape(-1)[:n] for a, b, n in zip(ends[:-1], ends[1:], sizes)]


def _code(spark: SparkSession, path: str) -> Code:
    """The code table has a row for each used id, so it is as small as the vocabulary."""
    rows = spark.read.parquet(f"{path}/code").orderBy("id").toPandas()
    return Code(rows["id"].to_numpy(np.int64), rows["length"].to_numpy(np.int64))


_SEGMENT = (
    "part int, segment int, before long, n long, doc_ids array<long>, sizes array<long>, "
    "checkpoints array<long>, payload binary"
)


def write_token_file(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    limit: int = 18,
    doc: str = "doc_id",
    text: str = "text",
) -> None:
    """Encode all texts and write the file at ``path``. Counting, ordering and coding are Spark jobs over
    stored token ids; only the counts (a row per vocabulary entry) come to the driver."""
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be 1 to {MAX_LIMIT}")
    spark = docs.sparkSession
    tokens = stored(token_table(docs, tokenizer, end_id, doc, text), "tokens", "zstd")
    counts = id_counts(tokens).orderBy("id").toPandas()
    ids, count = counts["id"].to_numpy(np.int64), counts["count"].to_numpy(np.int64)
    lengths = code_lengths(count, limit)
    rows = spark.createDataFrame(
        pa.table({"id": pa.array(ids, pa.int64()), "length": pa.array(lengths, pa.int64())})
    )
    rows.coalesce(1).write.parquet(f"{path}/code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = Code(ids, lengths), TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        docs_held: list = []
        segment = before = size = 0

        def flush() -> pa.RecordBatch:
            nonlocal segment, before, size, held, docs_held
            payload, checkpoints = code.encode(np.concatenate(held))
            row = [part, segment, before, size, docs_held, [len(x) for x in held], checkpoints.tolist(), payload]
            segment, before, size, held, docs_held = segment + 1, before + size, 0, [], []
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            widths = batch.column(1).to_numpy()
            for name, width, blob in zip(batch.column(0).to_pylist(), widths, batch.column(2)):
                held.append(ids_of(blob.as_buffer(), width))
                docs_held.append(name)
                size += len(held[-1])
                if size >= SEGMENT_IDS:
                    yield flush()
        if held:
            yield flush()

    number, listed = pa.int64(), pa.list_(pa.int64())
    schema = pa.schema(
        [("part", pa.int32()), ("segment", pa.int32()), ("before", number), ("n", number), ("doc_ids", listed)]
        + [("sizes", listed), ("checkpoints", listed), ("payload", pa.binary())]
    )
    parts = max(1, -(-int(count.sum()) // PART_IDS))
    order = [F.col("doc").asc_nulls_first(), "n", "ids"]
    ranged = tokens.repartitionByRange(parts, order[0]).sortWithinPartitions(*order)
    coded = ranged.select("doc", "width", "ids").mapInArrow(run, _SEGMENT)
    coded.write.option("compression", "none").parquet(f"{path}/segments")


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of the file, ``start`` being the ids of all documents
    before it and ``ids`` little-endian unsigned 32-bit integers. Segments are decoded where they lie; the
    driver sees one total per part, as many as there were tasks."""
    code = _code(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 32):  # about two million ids
                rows = batch.slice(first, 32)
                payloads = [x.as_buffer() for x in rows.column(5)]
                sizes = rows.column(2).to_pylist()
                found = code.decode(payloads, [np.array(x.as_py()) for x in rows.column(4)], sizes)
                for at, ids in enumerate(found):
                    lengths = np.array(rows.column(3)[at].as_py(), dtype=np.int64)
                    starts = np.concatenate([[0], np.cumsum(lengths)])
                    offsets = pa.py_buffer((starts * 4).astype(np.int32))
                    data = pa.py_buffer(ids.astype("<u4"))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(lengths), rows.column(0)[at].as_py(), dtype=np.int32)),
                            rows.column(6)[at].values,
                            pa.array(starts[:-1] + rows.column(1)[at].as_py()),
                            pa.array(lengths),
                            pa.Array.from_buffers(pa.binary(), len(lengths), [None, offsets, data]),
                        ],
                        names=["part", "doc_id", "start", "n_tokens", "ids"],
                    )

    segments = spark.read.schema(_SEGMENT).parquet(f"{path}/segments")
    totals = segments.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    before = np.cumsum([0, *(row.n for row in totals)])
    earlier = spark.createDataFrame(
        [(row.part, int(b)) for row, b in zip(totals, before)], "part int, __earlier long"
    )
    columns = ["part", "before", "n", "sizes", "checkpoints", "payload", "doc_ids"]
    decoded = segments.select(*columns).mapInArrow(
        run, "part int, doc_id long, start long, n_tokens long, ids binary"
    )
    return decoded.join(F.broadcast(earlier), "part").select(
        "doc_id", (F.col("start") + F.col("__earlier")).alias("start"), "n_tokens", "ids"
    )
