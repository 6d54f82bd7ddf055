"""Quality classifier by co-training of two views.

The text view sees the content: byte shares, how often words repeat, and line layout. The page view sees only what is known about a text without reading it: language, source, the given length, and
the host where there is a url. Each view has a logistic model. In every round both are fitted to
their training rows, label the rows of an unlabelled pool, and each hands the rows that it is surest about to the
training set of the other. At the end both are calibrated on labelled rows kept aside (Platt scaling), their
calibrated log-odds are combined by a third fit, and every document of the table is scored.

Fitting uses a bounded sample: ``Settings.labelled`` labelled rows, and ``Settings.pool_per_label`` unlabelled ones for
each of them, drawn by hash of the id, one row an id. Scoring sees all documents and whole texts, very long ones too.
Documents with a score below ``Settings.reject_below`` are rejected, which is low so that clean documents stay.

Null texts are empty; missing or null languages, sources, lengths and urls are a value of their own. Labels that are null
or of unknown documents play no part; a repeated label counts again. Of an id's rows the one with the smallest hash is
sampled; of pool rows that are equally sure the one with the smaller id goes first. If one of the two classes has no label, nothing can be learned: all scores are 1 and nothing is rejected. All columns of the documents
are kept; a column that has the name of the report is replaced; an empty table stays empty.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from oligoloom.llm.bytesets import NOT_SPACE, Slice, mix, slices, word_hashes, words

LANGUAGES, SOURCES, HOSTS = 8, 32, 32
TEXT_WIDTH, PAGE_WIDTH = 256 + 5, 2 + LANGUAGES + SOURCES + HOSTS
# What is known about a text without reading it; a missing column counts as null.
_METADATA = ("lang", "source", "n_chars", "url")
_TEXT, _PAGE = 0, 1

REPORT = StructType(
    [
        StructField("text", DoubleType()),
        StructField("page", DoubleType()),
        StructField("score", DoubleType()),
        StructField("keep", BooleanType()),
    ]
)


@dataclass(frozen=True)
class Settings:
    # Labelled rows to fit on, and rows without a label that may get a pseudo-label, for each of them.
    labelled: int = 6000
    pool_per_label: float = 1.0
    rounds: int = 4
    # Share of the pool that each view hands over in a round, and how sure it must be.
    handed: float = 0.05
    sure: float = 0.95
    # Every fifth labelled row is kept aside for calibration.
    aside: int = 5
    ridge: float = 1e-2
    reject_below: float = 0.4


def text_features(part: Slice) -> np.ndarray:
    """(rows, TEXT_WIDTH) of a slice: roots of byte shares, shares of new and repeated words, and line layout."""
    rows, size = len(part), np.diff(part.starts)
    row_of_byte = np.repeat(np.arange(rows), size)
    counts = np.bincount(row_of_byte * 256 + part.data, minlength=rows * 256).reshape(rows, 256)
    found = words(part, NOT_SPACE)
    hashes = word_hashes(part, found)
    n = found.counts()
    row = np.repeat(np.arange(rows), n)
    _, first = np.unique(hashes ^ mix(row.astype(np.uint64) + np.uint64(1)), return_index=True)
    again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])) + 1
    share = np.maximum(n, 1)
    lines = np.diff(np.searchsorted(np.flatnonzero(part.data == 0x0A), part.starts)) + 1
    extra = [
        np.bincount(row[first], minlength=rows) / share,
        np.bincount(row[again], minlength=rows) / share,
        np.log1p(n) / 10,
        np.log1p(n / lines),
        size / share,
    ]
    return np.hstack([np.sqrt(counts / np.maximum(size, 1)[:, None]), np.stack(extra, axis=1)])


def page_features(langs: list, sources: list, lengths: list, urls: list) -> np.ndarray:
    """(rows, PAGE_WIDTH): length if there is one, hashed language, source and host; nothing of the text."""
    out = np.zeros((len(langs), PAGE_WIDTH))
    out[:, 0] = [0 if x is None else math.log1p(max(0, x)) for x in lengths]
    out[:, 1] = [x is None for x in lengths]
    hosts = [None if u is None else str(u).partition("://")[2].partition("/")[0].lower() for u in urls]
    first = 2
    for values, buckets in ((langs, LANGUAGES), (sources, SOURCES), (hosts, HOSTS)):
        for at, value in enumerate(values):
            out[at, first + zlib.crc32(str(value).encode()) % buckets] = 1
        first += buckets
    return out


def _views(batch: pa.RecordBatch, text: str) -> Iterator[tuple[Slice, list[np.ndarray]]]:
    names = batch.schema.names

    def column(name: str, part: Slice) -> list:
        if name not in names:
            return [None] * len(part)
        return batch.column(names.index(name)).slice(part.first, len(part)).to_pylist()

    for part in slices(batch.column(names.index(text))):
        meta = [column(c, part) for c in _METADATA]
        yield part, [text_features(part), page_features(*meta)]


@dataclass
class Logistic:
    """Ridge-penalised logistic regression on standardised features."""

    ridge: float
    mean: np.ndarray = field(default=None)
    scale: np.ndarray = field(default=None)
    weights: np.ndarray = field(default=None)

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))])

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        design = self._design(x)
        w = np.zeros(design.shape[1])
        penalty = np.full(len(w), self.ridge * len(y))
        penalty[-1] = 1e-6
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            slope = design.T @ (p - y) + penalty * w
            curve = (design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty)
            step = np.linalg.solve(curve, slope)
            w = w - step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w
        return self

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._design(x) @ self.weights, -30, 30)


def _chance(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-odds))


@dataclass
class Model:
    views: list[Logistic]
    calibrated: list[Logistic]
    combined: Logistic

    def score(self, features: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        odds = [c.odds(v.odds(x)[:, None]) for v, c, x in zip(self.views, self.calibrated, features)]
        return _chance(odds[_TEXT]), _chance(odds[_PAGE]), _chance(self.combined.odds(np.stack(odds, axis=1)))


def co_train(
    labelled: list[np.ndarray], labels: np.ndarray, pool: list[np.ndarray], settings: Settings
) -> Model | None:
    """Fit both views; ``labelled`` and ``pool`` hold a feature matrix for each view."""
    aside = np.arange(len(labels)) % settings.aside == 0
    fitted, held = labels[~aside], labels[aside]
    if len(set(fitted.tolist())) < 2:
        return None
    if len(set(held.tolist())) < 2:  # too few rows to keep some aside
        aside[:], fitted, held = False, labels, labels
    x = [v[~aside] for v in labelled]
    y = [fitted, fitted]
    left = np.arange(len(pool[_TEXT]))
    quota = max(1, int(settings.handed * len(left)))
    views = [Logistic(settings.ridge).fit(x[v], y[v]) for v in (_TEXT, _PAGE)]
    for _ in range(settings.rounds):
        if len(left) == 0:
            break
        handed: set[int] = set()
        for giver, taker in ((_TEXT, _PAGE), (_PAGE, _TEXT)):
            good = _chance(views[giver].odds(pool[giver][left]))
            sure = np.maximum(good, 1 - good)
            best = np.argsort(-sure, kind="stable")[:quota]
            best = best[sure[best] >= settings.sure]
            rows = left[best]
            x[taker] = np.vstack([x[taker], pool[taker][rows]])
            y[taker] = np.concatenate([y[taker], (good[best] > 0.5).astype(float)])
            handed.update(rows.tolist())
        if not handed:
            break
        left = left[~np.isin(left, list(handed))]
        views = [Logistic(settings.ridge).fit(x[v], y[v]) for v in (_TEXT, _PAGE)]
    check = [v[aside] if aside.any() else v for v in labelled]
    odds = [view.odds(c) for view, c in zip(views, check)]
    calibrated = [Logistic(1e-3).fit(o[:, None], held) for o in odds]
    both = np.stack([c.odds(o[:, None]) for c, o in zip(calibrated, odds)], axis=1)
    return Model(views, calibrated, Logistic(1e-3).fit(both, held))


def _sampled_features(docs: DataFrame, ids: DataFrame, doc: str, text: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids and features of the documents in ``ids``, a sample of bounded size: one row an id, whichever has the
    smallest hash, however many rows share the id; the choice is combined before the shuffle."""
    others = [text, *[c for c in _METADATA if c in docs.columns]]
    rows = docs.select(F.col(doc).cast("long").alias(doc), *others).join(F.broadcast(ids), doc)
    row = F.struct(*others)
    rows = rows.groupBy(doc).agg(F.min_by(row, F.xxhash64(*others)).alias("row")).select(doc, "row.*")
    blob = pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, views in _views(batch, text):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.first, len(part)).cast(pa.int64()),
                        *(pa.array([r.tobytes() for r in v.astype("<f4")], blob) for v in views),
                    ],
                    names=["id", "a", "b"],
                )

    found = rows.mapInArrow(run, "id long, a binary, b binary").toArrow().sort_by("id")
    width = (TEXT_WIDTH, PAGE_WIDTH)
    views = [
        np.frombuffer(b"".join(found.column(1 + v).to_pylist()), "<f4").reshape(-1, width[v]).astype(np.float64)
        for v in (_TEXT, _PAGE)
    ]
    return found.column(0).to_numpy(), views


def fit_model(
    docs: DataFrame,
    labels: DataFrame,
    settings: Settings = Settings(),
    doc: str = "doc_id",
    text: str = "text",
    label: str = "quality",
) -> Model | None:
    known = labels.where(F.col(label).isNotNull() & F.col(doc).isNotNull()).select(
        F.col(doc).cast("long").alias(doc), F.col(label).cast("int").alias("__label")
    )
    draw = F.xxhash64(doc)
    chosen = known.orderBy(draw, "__label").limit(settings.labelled).toPandas()
    others = docs.select(F.col(doc).cast("long").alias(doc)).where(F.col(doc).isNotNull()).distinct()
    others = others.join(known.select(doc).distinct().hint("merge"), doc, "left_anti")
    pool = others.orderBy(draw).limit(math.ceil(len(chosen) * settings.pool_per_label)).toPandas()
    ids = np.unique(np.concatenate([chosen[doc].to_numpy(np.int64), pool[doc].to_numpy(np.int64)]))
    if len(ids) == 0:
        return None
    listed = docs.sparkSession.createDataFrame(pa.table({doc: pa.array(ids)}))
    found, views = _sampled_features(docs, listed, doc, text)
    if len(found) == 0:
        return None
    at = {int(d): i for i, d in enumerate(found.tolist())}
    rows = [(at[d], q) for d, q in zip(chosen[doc].tolist(), chosen["__label"].tolist()) if d in at]
    if not rows:
        return None
    mine = np.array([r for r, _ in rows])
    free = np.array([at[d] for d in pool[doc].tolist() if d in at], dtype=np.int64)
    truth = np.array([float(q > 0) for _, q in rows])
    return co_train([v[mine] for v in views], truth, [v[free] for v in views], settings)


def score_documents(
    docs: DataFrame, model: Model | None, settings: Settings = Settings(), text: str = "text", report: str = "quality"
) -> DataFrame:
    """The documents with both calibrated views, the combined score and the decision."""
    docs = docs.drop(report)
    kind = pa.struct([("text", pa.float64()), ("page", pa.float64()), ("score", pa.float64()), ("keep", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            if model is None:
                parts = [np.ones((batch.num_rows, 3))]
            else:
                parts = [np.stack(model.score(views), axis=1) for _, views in _views(batch, text)]
            scores = np.concatenate(parts) if parts else np.ones((0, 3))
            columns = [pa.array(scores[:, i]) for i in range(3)] + [pa.array(scores[:, 2] >= settings.reject_below)]
            quality = pa.StructArray.from_arrays(columns, fields=list(kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, quality], names=[*batch.schema.names, report])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(report, REPORT)]))
