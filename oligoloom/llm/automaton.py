"""Language-model scores from a weighted backoff automaton over words.

The model. Texts are lower-cased (A-Z) and cut into words; every text ends with an end token. The root state
has an arc for each training token w: (1 - u) c(w) / N, and u for all unknown words, u = (s + 1) / (N + s + 1)
with s tokens seen once. Every word v seen in training (and the start of a text) is a state with arcs to the
tokens seen after it. With k(v) = c(v) ** beta followers expected of a word seen c(v) times,

    P(w | v) = (c(v, w) + k(v) P(w)) / (c(v) + k(v)),

so a missing arc is a failure arc to the root with weight k(v) / (c(v) + k(v)). Each state sums to one. beta is
set so that the k(v) of all states add up to the number of different word pairs in training. A text is read
once from left to right: at each token the state's arc is taken, or its failure arc and then the root's, the
log-probability is added and the token becomes the state (an unknown one: the root, whose arcs need no backoff).

The work. Counts grow with the corpus, so they are never brought together: texts become chunks of about
``CHUNK_TOKENS`` tokens (a stored table of local word numbers), each chunk sends its different words and pairs
with their training counts as sorted arrays to shards of a 64-bit hash, a shard adds up what all chunks sent
and answers each chunk in the order of its request, and each chunk then scores its texts with the part of the
automaton it needs. Only totals (a few numbers a shard) reach the driver. Words are told apart by 64-bit hashes.

Null texts are empty: just the end token. A null id trains and is scored like any other, and is not held out.
Repeated rows count as often as they occur. Without training texts every word is unknown. Other columns play
no part; an empty table gives no scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oligoloom.llm.bytesets import NOT_SPACE, mix, slices, word_hashes, words
from oligoloom.llm.tables import stored

CHUNK_TOKENS = 2_000_000
# Tokens whose words and pairs one shard is meant to add up.
SHARD_TOKENS = 1_000_000

_END, _START = np.uint64(0x5EED0E4D), np.uint64(0x5EED57A7)
_ROOT, _PAIR = 0, 1
_BINS = 256


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    width = max((i + 1 for i in range(8) if planes[i].any()), default=1)
    body = planes[:width].tobytes()
    return bytes([width]) + len(values).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def unsqueeze(blob: bytes) -> np.ndarray:
    width, count = blob[0], int.from_bytes(blob[1:9], "little")
    body = pa.decompress(blob[9:], decompressed_size=width * count, codec="zstd", asbytes=True)
    planes = np.zeros((8, count), dtype=np.uint8)
    planes[:width] = np.frombuffer(body, dtype=np.uint8).reshape(width, count)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def squeeze_rising(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def unsqueeze_rising(blob: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(blob), dtype=np.uint64)


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


class Chunk:
    """Some whole texts: ids, tokens of each text (with its end), tokens as numbers into sorted ``keys``."""

    def __init__(self, doc_ids: list, sizes: np.ndarray, tokens: np.ndarray, keys: np.ndarray):
        self.doc_ids, self.sizes, self.tokens, self.keys = doc_ids, sizes, tokens, keys
        self.held = np.array([held_out(d) for d in doc_ids], dtype=bool)

    def requests(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For words and for pairs: rising keys, training counts, and each token's place among the keys."""
        trained = np.repeat(~self.held, self.sizes)
        ends = np.cumsum(self.sizes)
        state = np.concatenate([[-1], self.tokens[:-1]])
        state[ends[:-1]] = -1  # the first token of the next text
        pairs, place = np.unique((state + 1) * len(self.keys) + self.tokens, return_inverse=True)
        states = np.append(mix(self.keys), mix(_START[None])[0])[pairs // len(self.keys) - 1]
        codes = mix(states * np.uint64(3) + self.keys[pairs % len(self.keys)])
        order = np.argsort(codes)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        found = [(self.keys, self.tokens), (codes[order], rank[place])]
        return [(k, np.bincount(at[trained], minlength=len(k)).astype(np.int64), at) for k, at in found]

    def state_of_token(self) -> np.ndarray:
        """The word number of the token before each token, -1 at the start of a text."""
        state = np.concatenate([[-1], self.tokens[:-1]])
        state[np.cumsum(self.sizes)[:-1]] = -1
        return state


def chunks(docs: DataFrame, doc: str, text: str, chunk_tokens: int) -> DataFrame:
    """The texts as stored chunk rows; a chunk is filled by one task and closed at ``chunk_tokens``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        sizes: list[np.ndarray] = []
        hashes: list[np.ndarray] = []
        count = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, ids, sizes, hashes, count
            keys, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
            row = [number, count, ids, squeeze(np.concatenate(sizes)), squeeze(tokens), squeeze_rising(keys)]
            number, ids, sizes, hashes, count = number + 1, [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            names = batch.column(0).to_pylist()
            for part in slices(batch.column(1)):
                found = words(part, NOT_SPACE)
                hashes.append(np.insert(word_hashes(part, found), found.offsets[1:], _END))
                sizes.append(found.counts() + 1)
                ids += names[part.first : part.first + len(part)]
                count += len(hashes[-1])
                if count >= chunk_tokens:
                    yield flush()
        if ids:
            yield flush()

    blob = pa.binary()
    schema = pa.schema(
        [("chunk", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64()))]
        + [("sizes", blob), ("tokens", blob), ("keys", blob)]
    )
    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(
        run, "chunk long, n_tokens long, doc_ids array<long>, sizes binary, tokens binary, keys binary"
    )


def _chunk(row: dict) -> Chunk:
    tokens = unsqueeze(row["tokens"]).astype(np.int64)
    return Chunk(row["doc_ids"], unsqueeze(row["sizes"]).astype(np.int64), tokens, unsqueeze_rising(row["keys"]))


def _borders(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's keys begin and end: shards are equal ranges of the hash."""
    firsts = np.array([(s << 64) // shards for s in range(1, shards)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, firsts), [len(keys)]])


def requests(stored_chunks: DataFrame, shards: int) -> DataFrame:
    """(shard, kind, chunk, keys, counts): what each chunk asks each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for kind, (keys, counts, _) in enumerate(_chunk(row).requests()):
                    at = _borders(keys, shards)
                    used = np.flatnonzero(np.diff(at)).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(used, pa.int32()),
                            pa.array([kind] * len(used), pa.int32()),
                            pa.array([row["chunk"]] * len(used), pa.int64()),
                            pa.array([squeeze_rising(keys[at[s] : at[s + 1]]) for s in used], pa.binary()),
                            pa.array([squeeze(counts[at[s] : at[s + 1]]) for s in used], pa.binary()),
                        ],
                        names=["shard", "kind", "chunk", "keys", "counts"],
                    )

    return stored_chunks.mapInArrow(run, "shard int, kind int, chunk long, keys binary, counts binary")


_ANSWER = "kind int, chunk long, shard int, counts binary, types long, singles long, tokens long, bins array<long>"


def answers(asked: DataFrame) -> DataFrame:
    """Each request's counts over all training texts, and one row of totals for each shard and kind."""
    blob, whole = pa.binary(), pa.int64()
    schema = pa.schema(
        [("kind", pa.int32()), ("chunk", whole), ("shard", pa.int32()), ("counts", blob), ("types", whole)]
        + [("singles", whole), ("tokens", whole), ("bins", pa.list_(whole))]
    )

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        out = []
        for kind in (_ROOT, _PAIR):
            mine = [r for r in rows if r["kind"] == kind]
            if not mine:
                continue
            shard = mine[0]["shard"]
            keys = [unsqueeze_rising(r["keys"]) for r in mine]
            counts = np.concatenate([unsqueeze(r["counts"]) for r in mine]).astype(np.float64)
            different, place = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(place, weights=counts, minlength=len(different)).astype(np.int64)
            at = np.cumsum([0, *map(len, keys)])
            for r, a, b in zip(mine, at[:-1], at[1:]):
                out.append([kind, r["chunk"], shard, squeeze(total[place[a:b]]), None, None, None, None])
            seen = total[total > 0]
            bins = np.bincount(np.floor(4 * np.log2(seen)).astype(np.int64), minlength=_BINS)
            totals = [len(seen), int((seen == 1).sum()), int(seen.sum()), bins.tolist()]
            out.append([kind, None, shard, None, *totals])
        columns = list(zip(*out))
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return asked.groupBy("shard").applyInArrow(run, _ANSWER)


@dataclass(frozen=True)
class Totals:
    tokens: int
    types: int
    unknown: float
    start: int
    beta: float


def fit_beta(bins: np.ndarray, pairs: int) -> float:
    """The exponent for which the expected followers of all states add up to ``pairs``."""
    size = 2.0 ** ((np.arange(len(bins)) + 0.5) / 4)
    size[0] = 1.0
    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (bins * size**middle).sum() < pairs else (low, middle)
    return (low + high) / 2


def score_chunk(chunk: Chunk, counts: list[np.ndarray], totals: Totals) -> dict[str, np.ndarray]:
    """Read every text of the chunk once from left to right; ``counts`` answer the chunk's requests."""
    (_, _, root_at), (_, _, pair_at) = chunk.requests()
    c_word = counts[_ROOT][root_at].astype(np.float64)
    known = c_word > 0
    root = np.where(known, (1 - totals.unknown) * c_word / max(1, totals.tokens), totals.unknown)
    state = chunk.state_of_token()
    c_state = np.where(state < 0, totals.start, counts[_ROOT][state]).astype(np.float64)
    followers = np.where(c_state > 0, np.maximum(c_state, 1.0) ** totals.beta, 1.0)
    arc = counts[_PAIR][pair_at].astype(np.float64)
    score = np.log10((arc + followers * root) / (c_state + followers))
    base = np.log10((c_word + 0.5) / (totals.tokens + 0.5 * (totals.types + 1)))
    first = np.cumsum(chunk.sizes) - chunk.sizes
    return {
        "n_known": np.add.reduceat(known.astype(np.int64), first),
        "base_score": np.add.reduceat(base, first),
        "score": np.add.reduceat(score, first),
    }


_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scorer(totals: Totals) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        answered = right.sort_by("shard")
        for row in left.to_pylist():
            chunk = _chunk(row)
            counts = []
            for kind in (_ROOT, _PAIR):
                mine = answered.filter(pc.equal(answered["kind"], kind))["counts"]
                counts.append(np.concatenate([unsqueeze(x.as_py()) for x in mine]))
            found = score_chunk(chunk, counts, totals)
            parts.append(
                pa.table(
                    {
                        "doc_id": pa.array(chunk.doc_ids, pa.int64()),
                        "held_out": pa.array(chunk.held),
                        "n_tokens": pa.array(chunk.sizes),
                        **{name: pa.array(values) for name, values in found.items()},
                    }
                )
            )
        return pa.concat_tables(parts)

    return run


def score_texts(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", chunk_tokens: int = CHUNK_TOKENS
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    spark = docs.sparkSession
    held = stored(chunks(docs, doc, text, chunk_tokens), "lm-chunks", "none")
    tokens = held.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // SHARD_TOKENS))
    told = stored(answers(requests(held, shards)), "lm-counts", "none")
    sums = {
        r.kind: r
        for r in told.where("chunk is null")
        .groupBy("kind")
        .agg(*[F.sum(c).alias(c) for c in ("types", "singles", "tokens")])
        .collect()
    }
    spread = np.zeros(_BINS)
    bins = told.where(f"chunk is null and kind = {_ROOT}").select(F.posexplode("bins").alias("bin", "n"))
    for r in bins.groupBy("bin").agg(F.sum("n").alias("n")).collect():
        spread[r.bin] = r.n
    root, pairs = sums.get(_ROOT), sums.get(_PAIR)
    n, singles = (root.tokens, root.singles) if root else (0, 0)
    start = held.select(F.explode("doc_ids").alias("id")).where(
        F.coalesce(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(5)) != 1, F.lit(True))
    ).count()
    totals = Totals(
        tokens=n,
        types=root.types if root else 0,
        unknown=(singles + 1) / (n + singles + 1),
        start=start,
        beta=fit_beta(spread, pairs.types if pairs else 0),
    )
    left = held.select("chunk", "doc_ids", "sizes", "tokens", "keys").groupBy("chunk")
    right = told.where("chunk is not null").select("chunk", "kind", "shard", "counts").groupBy("chunk")
    scored = left.cogroup(right).applyInArrow(_scorer(totals), _SCORE)
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
