"""Near-duplicate join by a MinHash LSH forest, every link verified.

Documents are sets of shingles of ``shingle`` words (all words, if fewer). Two documents are linked when the
Jaccard similarity of their sets is at least ``threshold``.

* Copies (equal word sequences) form a class; one representative stands for it, with the number of copies.
* Each of ``TREES`` trees orders the representatives by a label of ``DEEPEST`` minimum hashes. Documents that
  share a prefix of their labels meet in a node of the tree. The prefix is shortened from the deepest level until
  two documents at the threshold meet in some tree with probability ``recall``: that is the node level used.
* Nodes of one document are dropped. A large node is split into blocks and the blocks meet in pairs (cells), so
  no task sees an unbounded node; a pair is treated in the first tree where it meets, and nowhere else.
* Only documents that have such a pair send their whole shingle sets to its cell, where similarities are exact.
  A cell never emits its pairs: it emits, for each document, the copies linked to it and the smallest
  representative that it hangs together with. Sums of these are the link counts; components follow from them by
  rounds of minimum labels with shortcuts.

Null texts and texts without words have no links and are classes of their own. Rows without an id take no part:
class null, no links. Repeated rows are copies of each other. Other columns play no part; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from oligoloom.llm.bytesets import ALNUM, Slice, Words, mix, slices, window_hashes, window_rows, word_hashes, words
from oligoloom.llm.tables import own_names, stored

TREES, DEEPEST = 12, 6
RECALL = 0.9995
# Documents of one node that a block holds; a cell is one block or a pair of them.
BLOCK_DOCS = 256
# Broadcast the list of documents to verify up to this many (8 bytes each); beyond, it is shuffled.
BROADCAST_DOCS = 4_000_000
_COLUMNS_AT_ONCE = 4096


def meeting_chance(similarity: float, depth: int, trees: int = TREES) -> float:
    """Probability that two documents share a prefix of ``depth`` minimum hashes in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def node_level(threshold: float, recall: float = RECALL) -> int:
    """Shorten the prefix until documents at the threshold meet as often as wanted."""
    for depth in range(DEEPEST, 0, -1):
        if meeting_chance(threshold, depth) >= recall:
            return depth
    raise ValueError(f"{TREES} trees can't reach a recall of {recall} at {threshold}")


def _factors(count: int) -> np.ndarray:
    return mix(np.arange(1, count + 1, dtype=np.uint64)) | np.uint64(1)


def shingles(part: Slice, found: Words, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, by row, and where each row's begin; a short text is one shingle."""
    begin, row = window_rows(found, length)
    codes = window_hashes(hashes, length)[begin]
    count = found.counts()
    short = np.flatnonzero((count > 0) & (count < length))
    whole = np.array(
        [window_hashes(hashes[found.offsets[r] : found.offsets[r + 1]], int(count[r]))[0] for r in short],
        dtype=np.uint64,
    )
    at = np.searchsorted(row, short)
    codes = np.insert(codes, at, whole)
    row = np.insert(row, at, short)
    return codes, np.searchsorted(row, np.arange(len(part) + 1))


def digests(found: Words, hashes: np.ndarray) -> list[bytes | None]:
    """128 bits of each row's word sequence; none for a text without words."""
    place = np.arange(len(hashes)) - np.repeat(found.offsets[:-1], found.counts())
    ranked = mix(place.astype(np.uint64) + np.uint64(1))
    halves = []
    for salt in (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)):
        running = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ salt ^ ranked) , dtype=np.uint64)])
        halves.append(running[found.offsets[1:]] - running[found.offsets[:-1]])
    pairs = np.ascontiguousarray(np.stack(halves, axis=1).astype("<u8"))
    return [pairs[r].tobytes() if n else None for r, n in enumerate(found.counts().tolist())]


def node_labels(codes: np.ndarray, starts: np.ndarray, level: int) -> np.ndarray:
    """(rows, trees): hash of each row's first ``level`` minimum hashes in every tree; 0 for an empty row."""
    filled = np.flatnonzero(np.diff(starts))
    labels = np.zeros((len(starts) - 1, TREES), dtype=np.uint64)
    if len(filled) == 0:
        return labels
    factors = _factors(TREES * DEEPEST)
    for tree in range(TREES):
        prefix = np.full(len(filled), mix(np.array([tree + 1], dtype=np.uint64))[0])
        for depth in range(level):
            least = np.minimum.reduceat(codes * factors[tree * DEEPEST + depth], starts[:-1][filled])
            prefix = mix(prefix * np.uint64(3) + least)
        labels[filled, tree] = prefix | np.uint64(1)
    return labels


def signatures(docs: DataFrame, doc: str, text: str, shingle: int, level: int) -> DataFrame:
    """(doc_id, digest, nodes): the class of every document and its node in each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                found = words(part, ALNUM)
                hashes = word_hashes(part, found)
                codes, starts = shingles(part, found, hashes, shingle)
                nodes = node_labels(codes, starts, level).view(np.int64)
                offsets = pa.array(np.arange(len(part) + 1) * TREES, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.first, len(part)),
                        pa.array(digests(found, hashes), pa.binary()),
                        pa.ListArray.from_arrays(offsets, pa.array(nodes.reshape(-1))),
                    ],
                    names=["doc_id", "digest", "nodes"],
                )

    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, digest binary, nodes array<long>")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(digest, shingles): sorted different shingle hashes of the texts in ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                found = words(part, ALNUM)
                hashes = word_hashes(part, found)
                codes, starts = shingles(part, found, hashes, shingle)
                sets = [np.unique(codes[a:b]).astype("<u8").tobytes() for a, b in zip(starts[:-1], starts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests(found, hashes), pa.binary()), pa.array(sets, pa.binary())],
                    names=["digest", "shingles"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "digest binary, shingles binary")


def meets_here_first(nodes: np.ndarray, tree: int, block: np.ndarray, i: int, j: int) -> np.ndarray:
    """(m, m), upper half: pairs of this cell's blocks that share no node of an earlier tree."""
    first = np.ones((len(nodes), len(nodes)), dtype=bool)
    for earlier in range(tree):
        column = nodes[:, earlier]
        first &= (column[:, None] != column[None, :]) | (column[:, None] == 0)
    if i != j:
        first &= block[:, None] != block[None, :]
    return np.triu(first, 1)


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """(m, m): sizes of the intersections, by sums of products over the shingles that occur twice or more."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[code] > 1
    owner, code = owner[shared], code[shared]
    number = np.cumsum(times > 1) - 1
    code = number[code]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    total = int(code[-1]) + 1 if len(code) else 0
    for first in range(0, total, _COLUMNS_AT_ONCE):
        a, b = np.searchsorted(code, [first, first + _COLUMNS_AT_ONCE])
        table = np.zeros((len(sets), min(_COLUMNS_AT_ONCE, total - first)), dtype=np.float32)
        table[owner[a:b], code[a:b] - first] = 1
        common += table @ table.T
    return common.astype(np.int64)


def linked(sets: list[np.ndarray], eligible: np.ndarray, threshold: float) -> np.ndarray:
    """(m, m), symmetric: eligible pairs with a similarity of at least ``threshold``."""
    size = np.array([len(s) for s in sets])
    common = common_counts(sets)
    # Similarities are fractions of small integers; the slack only undoes the rounding of the threshold.
    upper = eligible & (common >= threshold * (size[:, None] + size[None, :] - common) * (1 - 1e-12))
    return upper | upper.T


def _least_connected(links: np.ndarray) -> np.ndarray:
    """For each member the first member that it hangs together with."""
    label = np.arange(len(links))
    while True:
        lowest = np.where(links, label[None, :], len(links)).min(axis=1)
        new = np.minimum(label, lowest)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by (node, i, j) as one table a cell; a cell may span batches."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        if table.num_rows == 0:
            continue
        node, i, j = (table.column(c).to_numpy() for c in ("node", "i", "j"))
        cuts = np.flatnonzero((np.diff(node) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        begin = 0
        for cut in cuts.tolist():
            yield table.slice(begin, cut - begin)
            begin = cut
        rest = table.slice(begin)
    if rest is not None and rest.num_rows:
        yield rest


def _nodes_of(cell: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in cell.column("nodes")), dtype="<i8").reshape(-1, TREES)


_MEMBER = "node long, i int, j int, tree int, block int, digest binary, rep long, copies long, nodes binary"


def cells(signed: DataFrame) -> DataFrame:
    """Representatives in all the cells of their nodes that hold others."""
    reps = (
        signed.where("digest is not null and doc_id is not null")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("nodes").alias("nodes"))
    )
    spread = reps.select("digest", "rep", "copies", F.posexplode("nodes").alias("tree", "node"))
    crowded = spread.groupBy("node").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    alive = spread.join(crowded, "node").groupBy("digest").agg(
        F.first("rep").alias("rep"),
        F.first("copies").alias("copies"),
        F.collect_list(F.struct("tree", "node", "members")).alias("found"),
    )
    # Nodes of one document can't be shared, so only the crowded ones are carried along.
    packed = ", ".join(
        f"unhex(coalesce(get(transform(filter(found, f -> f.tree = {t}), f -> swap64(f.node)), 0), repeat('0', 16)))"
        for t in range(TREES)
    )
    little_endian = "concat_ws('', transform(sequence(0, 7), b -> lpad(hex(shiftright(f.node, 8 * b) & 255), 2, '0')))"
    nodes = F.expr(f"concat({packed})".replace("swap64(f.node)", little_endian))
    placed = alive.select("digest", "rep", "copies", nodes.alias("nodes"), F.explode("found").alias("f")).select(
        F.col("f.node").alias("node"),
        F.col("f.tree").alias("tree"),
        F.ceil(F.col("f.members") / BLOCK_DOCS).cast("int").alias("blocks"),
        "digest",
        "rep",
        "copies",
        "nodes",
    )
    placed = placed.withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return placed.select(
        "node",
        F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"),
        "tree",
        "block",
        "digest",
        "rep",
        "copies",
        "nodes",
    )


def meeting_members(placed: DataFrame) -> DataFrame:
    """Members of cells that meet another one there, in no earlier tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []
        count = 0
        for cell in _by_cell(batches):
            if cell.num_rows < 2:
                continue
            tree, i, j = (cell.column(c)[0].as_py() for c in ("tree", "i", "j"))
            block = cell.column("block").to_numpy()
            first = meets_here_first(_nodes_of(cell), tree, block, i, j)
            some = np.flatnonzero(first.any(axis=0) | first.any(axis=1))
            if len(some):
                kept.append(cell.take(pa.array(some)))
                count += len(some)
            if count > 20_000:
                yield from pa.concat_tables(kept).combine_chunks().to_batches()
                kept, count = [], 0
        if kept:
            yield from pa.concat_tables(kept).combine_chunks().to_batches()

    keys = ["node", "i", "j"]
    return placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, _MEMBER)


def verified(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(digest, links, root): from each cell, a document's linked copies and the first it hangs together with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _by_cell(batches):
            tree, i, j = (cell.column(c)[0].as_py() for c in ("tree", "i", "j"))
            # A text can come with the set of several rows of one id; members are the same again.
            order = {}
            for at, digest in enumerate(cell.column("digest").to_pylist()):
                order.setdefault(digest, at)
            cell = cell.take(pa.array(list(order.values())))
            names = cell.column("digest").to_pylist()
            sets = [np.frombuffer(x.as_py(), dtype="<u8") for x in cell.column("shingles")]
            eligible = meets_here_first(_nodes_of(cell), tree, cell.column("block").to_numpy(), i, j)
            links = linked(sets, eligible, threshold)
            some = np.flatnonzero(links.any(axis=1))
            if len(some):
                weight = links @ cell.column("copies").to_numpy()
                root = _least_connected(links)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([names[m] for m in some], pa.binary()),
                        pa.array(weight[some], pa.int64()),
                        pa.array([names[root[m]] for m in some], pa.binary()),
                    ],
                    names=["digest", "links", "root"],
                )

    keys = ["node", "i", "j"]
    rows = members.join(sets.hint("merge"), "digest").repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(run, "digest binary, links long, root binary")


def components(edges: DataFrame) -> DataFrame:
    """(v, label): the smallest vertex that each vertex of ``edges`` (a, b) hangs together with. Labels spread
    along edges and are then replaced by their own labels, so long chains shrink fast; each round is stored."""
    both = stored(edges.unionAll(edges.select("b", "a")).distinct(), "component-edges")
    labels = both.groupBy("a").agg(F.min("b").alias("least")).select(
        F.col("a").alias("v"), F.least("a", "least").alias("label")
    )
    while True:
        labels = stored(labels, "component-labels")
        near = (
            both.join(labels.select(F.col("v").alias("b"), F.col("label").alias("near")), "b")
            .groupBy(F.col("a").alias("v"))
            .agg(F.min("near").alias("near"))
        )
        spread = labels.join(near, "v").select("v", F.least("label", "near").alias("new"), "label")
        jump = labels.select(F.col("v").alias("new"), F.col("label").alias("jump"))
        moved = stored(
            spread.join(jump, "new", "left").select(
                "v", F.least("new", F.coalesce("jump", "new")).alias("next"), "label"
            ),
            "component-round",
        )
        if moved.where("next != label").isEmpty():
            return labels
        labels = moved.select("v", F.col("next").alias("label"))


def near_duplicates(
    docs: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    shingle: int = 5,
    threshold: float = 0.8,
    recall: float = RECALL,
) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) of every document: the smallest id of the group it hangs together
    with, the documents linked to it (its copies included) and how many rows have its words (itself included)."""
    return _grouped(docs, doc, text, shingle, threshold, recall).drop("digest", "label")


def _grouped(
    docs: DataFrame, doc: str, text: str, shingle: int = 5, threshold: float = 0.8, recall: float = RECALL
) -> DataFrame:
    """``near_duplicates`` with the row's ``digest`` and its group's ``label``, both null for rows that stand alone."""
    docs = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = stored(signatures(docs, "doc_id", "text", shingle, node_level(threshold, recall)), "signatures")
    members = stored(meeting_members(cells(signed)), "cell-members")
    wanted = stored(members.select(F.col("rep").alias("doc_id")).distinct(), "to-verify")
    # Small enough to be sent everywhere, or else shuffled like the documents.
    hint = F.broadcast(wanted) if wanted.count() <= BROADCAST_DOCS else wanted.hint("merge")
    sets = shingle_sets(docs.join(hint, "doc_id"), shingle)
    found = stored(verified(members, sets, threshold), "links")
    groups = components(found.select(F.col("digest").alias("a"), F.col("root").alias("b")))
    reps = (
        signed.where("digest is not null and doc_id is not null")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    )
    linked_reps = (
        reps.join(found.groupBy("digest").agg(F.sum("links").alias("links")), "digest", "left")
        .join(groups.withColumnRenamed("v", "digest"), "digest", "left")
        .withColumn("label", F.coalesce("label", "digest"))
    )
    linked_reps = stored(linked_reps, "linked-classes")
    names = linked_reps.groupBy("label").agg(F.min("rep").alias("class_id"))
    classes = linked_reps.join(names, "label").select("digest", "label", "class_id", "links", "copies")
    alone = F.col("digest").isNull() | F.col("doc_id").isNull()
    return (
        signed.select("doc_id", "digest")
        .join(classes, "digest", "left")
        .select(
            "doc_id",
            F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
            F.when(alone, F.lit(0)).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
            .cast("long")
            .alias("n_links"),
            F.when(alone, F.lit(1)).otherwise(F.col("copies")).cast("long").alias("n_copies"),
            F.when(~alone, F.col("digest")).alias("digest"),
            F.when(~alone, F.col("label")).alias("label"),
        )
    )


@F.arrow_udf(BinaryType())
def _digest_of(texts: pa.Array) -> pa.Array:
    found = []
    for part in slices(texts):
        inside = words(part, ALNUM)
        found += digests(inside, word_hashes(part, inside))
    return pa.array(found, pa.binary())


def without_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without all but one row of each group: one of the smallest id in the group whose own text belongs
    to it, of several such texts the one of the smallest digest, of rows with equal words the smallest text. Other rows
    of the same id are judged by their own groups. Rows without words all stay, equal ones of an id once; rows without
    an id all stay."""
    leads_name, digest_name, row_name = own_names(docs, "leads", "digest", "row")
    grouped = _grouped(docs, doc, text, **options).select("doc_id", "class_id", "digest", "label")
    found = stored(grouped.where(F.col("doc_id").isNotNull()), "near-duplicates")
    counted = found.groupBy("doc_id").agg(
        F.max(F.col("class_id") == F.col("doc_id")).alias(leads_name), F.count(F.lit(1)).alias("rows")
    )
    goes = stored(
        counted.where(f"rows > 1 or not {leads_name}").select(F.col("doc_id").alias(doc), leads_name), "duplicates"
    )
    listed = goes.select(doc)
    stays = docs.join(
        F.broadcast(listed) if goes.count() <= BROADCAST_DOCS else listed.hint("merge"), doc, "left_anti"
    )
    mixed = goes.where(leads_name).select(doc)
    if mixed.isEmpty():
        return stays
    # Ids of several rows, some of which lead a group: these rows are told apart by their words.
    again = docs.join(mixed.hint("merge"), doc, "left_semi").withColumn(digest_name, _digest_of(F.col(text).cast("string")))
    leads = (
        found.where("class_id = doc_id and digest is not null")
        .groupBy("label", F.col("doc_id").alias(doc))
        .agg(F.min("digest").alias(digest_name))
        .drop("label")
    )
    chosen = again.join(leads, [doc, digest_name], "left_semi").select(*again.columns)
    wordless = again.where(f"{digest_name} is null")
    row, order = F.struct(*docs.columns), F.coalesce(F.col(text), F.lit(""))
    one = chosen.unionByName(wordless).groupBy(doc, digest_name, F.when(F.col(digest_name).isNull(), F.col(text)))
    return stays.unionByName(one.agg(F.min_by(row, order).alias(row_name)).select(f"{row_name}.*"))
