"""Benchmark decontamination: find the word windows of benchmark items in training documents.

Texts are lower-cased (A-Z) and cut into words; a window is ``length`` consecutive words of an item, or all
words of a shorter one. The windows are a set hashed in memory and broadcast to the tasks: never more than
``SET_BYTES`` at a time. A larger set is split by hash and the documents are scanned once for each part, so
memory stays bounded whatever the benchmark. Every hash hit is verified against the window's words.

Null and wordless texts have no words and no hits; items without words have no windows; windows of items
without an id mark words but name no item; repeated rows, items and windows are judged alike; with no
documents or no items nothing is hit. All columns of the documents are kept; a column that has the name of
the report is replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from oligoloom.llm.bytesets import ALNUM, Slice, Words, slices, window_hashes, window_rows, word_hashes, words
from oligoloom.llm.tables import own_names, stored

WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Bytes of window texts (and ids) that are broadcast at once.
SET_BYTES = 64 << 20
_FILTER_BITS = 20

REPORT = StructType(
    [
        StructField("n_words", LongType()),
        StructField("n_hit", LongType()),
        StructField("items", ArrayType(StringType())),
        StructField(
            "spans", ArrayType(StructType([StructField("begin", IntegerType()), StructField("end", IntegerType())]))
        ),
    ]
)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def item_windows(items: DataFrame, length: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """(window, size, items): each different window, its words and the ids of the items that hold it."""
    found = F.regexp_extract_all(lower_ascii(F.col(text).cast("string")), F.lit(WORD_PATTERN), F.lit(0))
    rows = items.select(F.col(item).cast("string").alias("item"), found.alias("w")).where(F.size("w") > 0)
    rows = rows.withColumn("size", F.least(F.size("w"), F.lit(length)))
    windows = rows.select(
        "item",
        "size",
        F.explode(
            F.expr("transform(sequence(1, size(w) - size + 1), i -> array_join(slice(w, i, size), ' '))")
        ).alias("window"),
    )
    return windows.groupBy("window", "size").agg(F.collect_set("item").alias("items"))


class WindowSet:
    """Windows by hash, in front of them a bitmap that turns most lookups away."""

    def __init__(self, rows: list[tuple[str, int, list[str]]]):
        self.known: dict[int, dict[int, list[tuple[bytes, list[str]]]]] = defaultdict(lambda: defaultdict(list))
        self.maybe: dict[int, np.ndarray] = {}
        column = pa.array([window for window, _, _ in rows], pa.string())
        for part in slices(column):
            found = words(part, ALNUM)
            hashes = word_hashes(part, found)
            for row in range(len(part)):
                window, size, items = rows[part.first + row]
                code = int(window_hashes(hashes[found.offsets[row] : found.offsets[row + 1]], size)[0])
                self.known[size][code].append((window.encode(), items))
        for size, codes in self.known.items():
            self.maybe[size] = np.zeros(1 << _FILTER_BITS, dtype=bool)
            places = np.fromiter(codes, dtype=np.uint64, count=len(codes)) & np.uint64((1 << _FILTER_BITS) - 1)
            self.maybe[size][places.astype(np.int64)] = True

    def hits(self, part: Slice, found: Words, hashes: np.ndarray) -> Iterator[tuple[int, int, int, list[str]]]:
        """(row, first word, words, items) of every verified window."""
        mask = np.uint64((1 << _FILTER_BITS) - 1)
        for size, codes in self.known.items():
            codes_at = window_hashes(hashes, size)
            begin, row = window_rows(found, size)
            likely = np.flatnonzero(self.maybe[size][(codes_at[begin] & mask).astype(np.int64)])
            for at, r in zip(begin[likely].tolist(), row[likely].tolist()):
                for window, items in codes.get(int(codes_at[at]), ()):
                    spans = zip(found.begin[at : at + size].tolist(), found.end[at : at + size].tolist())
                    if b" ".join(part.data[a:b].tobytes() for a, b in spans).lower() == window:
                        yield r, at, size, items


def scan_slice(part: Slice, windows: WindowSet) -> list[dict]:
    """The report of every row of a slice."""
    found = words(part, ALNUM)
    hashes = word_hashes(part, found)
    change = np.zeros(len(found) + 1, dtype=np.int64)
    items: dict[int, set[str]] = defaultdict(set)
    for row, at, size, names in windows.hits(part, found, hashes):
        change[at] += 1
        change[at + size] -= 1
        items[row].update(names)
    hit = np.cumsum(change[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(hit)])
    n_hit = total[found.offsets[1:]] - total[found.offsets[:-1]]
    reports = []
    for row, (n, h) in enumerate(zip(found.counts().tolist(), n_hit.tolist())):
        spans = []
        if h:
            own = hit[found.offsets[row] : found.offsets[row + 1]]
            marks = np.flatnonzero(np.diff(np.concatenate([[0], own, [0]]))).tolist()
            spans = [{"begin": begin, "end": end} for begin, end in zip(marks[::2], marks[1::2])]
        reports.append({"n_words": n, "n_hit": h, "items": sorted(items.get(row, ())), "spans": spans})
    return reports


def _scan(docs: DataFrame, rows: list, text: str, report: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast([(r.window, r.size, list(r.items)) for r in rows])
    at = docs.columns.index(text)
    span = pa.struct([("begin", pa.int32()), ("end", pa.int32())])
    kind = pa.struct(
        [("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(span))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = WindowSet(shared.value)
        for batch in batches:
            reports = [r for part in slices(batch.column(at)) for r in scan_slice(part, windows)]
            columns = [*batch.columns, pa.array(reports, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, report])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(report, REPORT)]))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    length: int = 10,
    text: str = "text",
    report: str = "contamination",
    item: str = "item_id",
    item_text: str = "text",
    set_bytes: int = SET_BYTES,
) -> DataFrame:
    """The documents with a report: words, words inside a window of an item, ids (sorted as strings) of the
    items with such windows, and the hit words as ranges of word numbers."""
    windows = stored(item_windows(items, length, item, item_text), "windows")
    weight = F.octet_length("window") + 16 + F.coalesce(
        F.aggregate("items", F.lit(0), lambda total, x: total + F.octet_length(x) + 8), F.lit(0)
    )
    parts = max(1, -(-(windows.agg(F.sum(weight)).first()[0] or 0) // set_bytes))
    docs = docs.drop(report)
    if parts == 1:
        return _scan(docs, windows.collect(), text, report)
    hit_name, *seen = own_names(docs, "hit", *[f"{report}_{part}" for part in range(parts)])
    for part, column in enumerate(seen):
        some = windows.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == part).collect()
        docs = stored(_scan(docs, some, text, column), "contamination")
    ranges = F.flatten(F.array(*[F.col(f"{c}.spans") for c in seen]))
    hit = F.array_sort(F.array_distinct(F.flatten(F.transform(ranges, lambda r: F.sequence(r.begin, r.end - 1)))))
    docs = docs.withColumn(hit_name, hit)
    # A hit word opens a span if the word before it isn't hit, and closes one if the word after isn't.
    opens = F.expr(f"filter({hit_name}, (x, i) -> i = 0 or {hit_name}[i - 1] < x - 1)")
    closes = F.expr(f"filter({hit_name}, (x, i) -> i = size({hit_name}) - 1 or {hit_name}[i + 1] > x + 1)")
    merged = F.struct(
        F.col(f"{seen[0]}.n_words").alias("n_words"),
        F.size(hit_name).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"{c}.items") for c in seen])))).alias("items"),
        F.zip_with(opens, closes, lambda a, b: F.struct(a.alias("begin"), (b + 1).alias("end"))).alias("spans"),
    )
    return docs.withColumn(report, merged).drop(hit_name, *seen)


def without_spans(reported: DataFrame, text: str = "text", report: str = "contamination") -> DataFrame:
    """The documents with the hit words (and what stands between them) cut out of the text."""
    at, where = reported.columns.index(text), reported.columns.index(report)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list = batch.column(at).to_pylist()
            for part in slices(batch.column(at)):
                found = words(part, ALNUM)
                for row in range(len(part)):
                    spans = batch.column(where)[part.first + row].as_py()["spans"]
                    if spans:
                        whole, first, base = part.text(row), found.offsets[row], part.starts[row]
                        kept, after = [], 0
                        for span in spans:
                            kept.append(whole[after : found.begin[first + span["begin"]] - base])
                            after = found.end[first + span["end"] - 1] - base
                        texts[part.first + row] = b"".join([*kept, whole[after:]]).decode()
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.types[at])
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return reported.mapInArrow(run, reported.schema)


def clean_documents(docs: DataFrame, items: DataFrame, length: int = 10, text: str = "text") -> DataFrame:
    """The documents that hold no window of any item."""
    [report] = own_names(docs, "contamination")
    return contamination(docs, items, length, text, report).where(F.col(f"{report}.n_hit") == 0).drop(report)
