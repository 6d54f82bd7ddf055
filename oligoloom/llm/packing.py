"""Pack token pieces into as few sequences of a fixed length as possible.

A document is its ids and an end id. Only longer ones than a sequence are cut: into full pieces behind a
first one that takes the remainder. Pieces are dealt over groups of ``GROUP_PIECES``; a group is packed by
one task: best fit by falling length, then a local search over the underfull sequences. The search takes
the emptier sequences first and moves one or two of a sequence's pieces to another one, or exchanges them for
one or two pieces that are shorter together, so that the other sequence gets fuller than this one was. Of all such
steps of a sequence it takes the one that raises the sum of squared fills most. It ends when every underfull sequence has
been tried against all others without a step, which comes by itself, as the sum rises with each step; or early, when
a group has as few sequences as its tokens allow. What stands in the emptiest sequence of every group meets once more
in groups of its own, until there is one, so that dealing over groups does not cost a sequence each.

Null texts are empty (a lone end id); very long ones are cut; null, repeated document ids and repeated rows are packed
like any other row; pieces of one length may change places with each other; other columns play no part; no documents
give no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oligoloom.llm.bytesets import slices
from oligoloom.llm.tables import stored
from oligoloom.llm.tokens import ENCODE_BYTES, encoder, with_end

GROUP_PIECES = 16_384

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = f"{_PIECE}, sequence_id long, offset long"


def cut_lengths(total: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of ``total`` ids."""
    rest = total % capacity
    return [rest] * (rest > 0) + [capacity] * (total // capacity)


def pieces(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int, doc: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch.column(1), ENCODE_BYTES):
                ids, before = with_end(*coder.encode(part), end_id)
                data = ids.astype("<u4")
                row, number, start, length, crc = [], [], [], [], []
                for i, (begin, end) in enumerate(zip(before[:-1].tolist(), before[1:].tolist())):
                    at = begin
                    for k, size in enumerate(cut_lengths(end - begin, capacity)):
                        row.append(i)
                        number.append(k)
                        start.append(at - begin)
                        length.append(size)
                        crc.append(zlib.crc32(data[at : at + size]))
                        at += size
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.first, len(part)).take(pa.array(row, pa.int64())),
                        pa.array(number, pa.int32()),
                        *(pa.array(x, pa.int64()) for x in (start, length, crc)),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, _PIECE)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Sequences (lists of piece numbers); each piece, longest first, goes where least room stays."""
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some sequence has room r
    bins: list[list[int]] = []
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size = lengths[piece]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms &= ~(1 << room)
            bins[at].append(piece)
        else:
            room, at = capacity, len(bins)
            bins.append([piece])
        if room > size:
            open_by_room[room - size].append(at)
            rooms |= 1 << (room - size)
    return bins


class Search:
    """Local search over the underfull sequences of a packing.

    A choice takes nothing, one piece or two pieces out of a sequence and has room for as much and the sequence's free
    place. Choices of all underfull sequences stand in one array, in the order in which the sequences last changed, so
    that a victim looks again only at those that changed since it last found no step.
    """

    def __init__(self, lengths: list[int], bins: list[list[int]], capacity: int):
        self.lengths, self.bins, self.capacity = lengths, bins, capacity
        self.fill = [sum(lengths[p] for p in b) for b in bins]
        self.steps = 0
        self.taken, self.owner = np.zeros(1024, np.int64), np.full(1024, -1, np.int64)
        self.end = self.live = 0
        self.place = [(0, 0)] * len(bins)
        self.tried = np.zeros(len(bins), np.int64)
        self.room = np.array([capacity - f for f in self.fill], np.int64)

    def run(self) -> list[list[int]]:
        least = -(-sum(self.fill) // self.capacity)
        alive = sum(1 for f in self.fill if f)
        if alive > least:
            for b in range(len(self.bins)):
                self._list(b)
        before = -1
        while alive > least and before < self.steps:
            before = self.steps
            for victim in sorted(range(len(self.bins)), key=lambda b: (self.fill[b], b)):
                if 0 < self.fill[victim] < self.capacity:
                    alive -= self._empty(victim)
                    if alive == least:
                        break
        return [b for b in self.bins if b]

    def _sums(self, b: int) -> np.ndarray:
        """Different lengths of one piece and of two pieces of a sequence; it has few different lengths, because
        their sum is bounded by its capacity."""
        sizes, count = np.unique([self.lengths[p] for p in self.bins[b]], return_counts=True)
        first, second = np.triu_indices(len(sizes), 1)
        return np.unique(np.concatenate([sizes, sizes[first] + sizes[second], 2 * sizes[count > 1]]))

    def _list(self, b: int) -> None:
        """Put the choices of a sequence that changed behind all others."""
        begin, end = self.place[b]
        self.owner[begin:end] = -1
        self.live -= end - begin
        self.tried[b] = 0
        if not 0 < self.fill[b] < self.capacity:
            self.place[b] = (0, 0)
            return
        found = np.append(0, self._sums(b))
        if self.end + len(found) > len(self.taken):
            self._compact(len(found))
        self.place[b] = (self.end, self.end + len(found))
        self.taken[self.end : self.end + len(found)] = found
        self.owner[self.end : self.end + len(found)] = b
        self.end += len(found)
        self.live += len(found)

    def _compact(self, more: int) -> None:
        used = self.owner[: self.end] >= 0
        before = np.append(0, np.cumsum(used))
        size = 2 * (self.live + more) + 1024
        taken, owner = self.taken[: self.end][used], self.owner[: self.end][used]
        self.taken, self.owner = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self.taken[: len(taken)], self.owner[: len(owner)] = taken, owner
        self.place = [(int(before[i]), int(before[j])) for i, j in self.place]
        self.tried, self.end = before[self.tried], len(taken)

    def _empty(self, victim: int) -> bool:
        """Take pieces out of ``victim`` while some step allows it."""
        while self.bins[victim]:
            step = self._step(victim)
            if step is None:
                self.tried[victim] = self.end
                return False
            self.steps += 1
            other, given, taken = step
            for source, target, total in ((victim, other, given), (other, victim, taken)):
                for p in self._pieces(source, total):
                    self.bins[source].remove(p)
                    self.bins[target].append(p)
            for b, gain in ((other, given - taken), (victim, taken - given)):
                self.fill[b] += gain
                self.room[b] -= gain
            self._list(other)
            self._list(victim)
        return True

    def _step(self, victim: int) -> tuple[int, int, int] | None:
        """The step that raises the sum of squared fills most: (other sequence, length given, length taken)."""
        begin = int(self.tried[victim])
        owner, taken = self.owner[begin : self.end], self.taken[begin : self.end]
        sums = np.append(0, self._sums(victim))
        largest = sums[np.searchsorted(sums, np.arange(self.capacity + 1), "right") - 1]
        room = self.room[owner]
        # More is always better, so the largest length that fits is the only one to look at.
        gain = np.where(owner >= 0, largest[np.where(owner >= 0, taken + room, 0)] - taken, 0)
        # The other one ends up fuller than this one was, which raises the sum.
        rise = gain + self.capacity - room - self.fill[victim]
        usable = np.flatnonzero((gain > 0) & (rise > 0) & (owner != victim))
        if not len(usable):
            return None
        at = usable[np.argmax(gain[usable] * rise[usable])]
        return int(owner[at]), int(gain[at] + taken[at]), int(taken[at])

    def _pieces(self, b: int, total: int) -> list[int]:
        """No piece, one or two of a sequence that are ``total`` long together."""
        if total == 0:
            return []
        seen: dict[int, int] = {}
        pair: list[int] = []
        for p in self.bins[b]:
            size = self.lengths[p]
            if size == total:
                return [p]
            if not pair and total - size in seen:
                pair = [seen[total - size], p]
            seen.setdefault(size, p)
        return pair


def pack_group(lengths: list[int], capacity: int) -> list[list[int]]:
    return Search(lengths, best_fit(lengths, capacity), capacity).run()


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int = 2048,
    doc: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Every piece with its ``sequence_id`` and its ``offset`` there."""

    cut = stored(pieces(docs, tokenizer, end_id, capacity, doc, text), "pieces")
    packed, left, level = [], cut, 0
    while True:
        # A sequence holds at most ``capacity`` pieces, so at most a quarter of a level's groups is left for the next.
        groups = max(1, -(-left.count() // max(GROUP_PIECES, 4 * capacity)))
        found = left.repartition(groups).mapInArrow(_group_packer(capacity, level), f"{_PACKED}, leftover boolean")
        if groups == 1:
            break
        found = stored(found, "packed")
        packed.append(found.where("not leftover").drop("leftover"))
        left, level = found.where("leftover").select(cut.columns), level + 1
    found = found.drop("leftover")
    for part in packed:
        found = found.unionByName(part)
    return found


def _group_packer(capacity: int, level: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs what a task holds; the pieces of its emptiest sequence are marked as left over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        lengths = table.column("length").to_pylist()
        sequence, offset, leftover = [0] * len(lengths), [0] * len(lengths), [False] * len(lengths)
        first = level << 56 | TaskContext.get().partitionId() << 24
        sequences = pack_group(lengths, capacity)
        emptiest = min(range(len(sequences)), key=lambda n: sum(lengths[p] for p in sequences[n]))
        for number, members in enumerate(sequences):
            at = 0
            for p in sorted(members):
                sequence[p], offset[p], leftover[p] = first + number, at, number == emptiest
                at += lengths[p]
        for name, values, kind in (
            ("sequence_id", sequence, pa.int64()),
            ("offset", offset, pa.int64()),
            ("leftover", leftover, pa.bool_()),
        ):
            table = table.append_column(name, pa.array(values, kind))
        yield from table.to_batches()

    return run
