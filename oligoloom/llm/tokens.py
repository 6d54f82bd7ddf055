"""Token ids of whole texts with the tokenizers library, for tasks that see very many texts.

The library splits a text by its byte-level pattern and encodes each piece on its own. Pieces
repeat far more often than texts do, so a task splits the texts itself (vectorised), lets the
library encode each distinct piece once and looks the rest up. Only texts of characters below
U+0250, whose classes have been fixed for decades, are split here; the library takes all others
whole, and so it does texts that hold the content of an added token such as <|endoftext|>, which it
finds before it splits. A test compares both ways.
"""

from __future__ import annotations

import json
import unicodedata
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from oligoloom.llm.bytesets import Slice

_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
_KNOWN_BELOW = 0x250
_APOSTROPHE = 0x27
# Contractions that the pattern takes first.
_SHORT, _LONG = b"stmd", (b"re", b"ve", b"ll")
# Bytes of text that are split at once: pieces repeat more in longer slices.
ENCODE_BYTES = 2 << 20
# Distinct pieces that a Python worker remembers, about 200 bytes each.
MEMO_PIECES = 600_000


def _class_of(code: int) -> int:
    if code in (0x20, 0x85, 0xA0) or 9 <= code <= 13:
        return _SPACE
    return {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(code))[0], _OTHER)


_CLASSES = np.array([_class_of(code) for code in range(_KNOWN_BELOW)], dtype=np.uint8)
_ASCII = np.concatenate([_CLASSES[:128], np.zeros(128, dtype=np.uint8)])


def piece_starts(part: Slice) -> np.ndarray:
    """Byte positions where the pieces of a slice begin; every character must be below U+0250."""
    data, size = part.data, len(part.data)
    kind = _ASCII[data]
    lead = np.flatnonzero(data >= 0xC0)
    kind[lead] = _CLASSES[((data[lead].astype(np.int64) & 0x1F) << 6) | (data[lead + 1] & 0x3F)]
    kind[lead + 1] = kind[lead]
    row_start = np.zeros(size + 1, dtype=bool)
    row_start[part.starts] = True
    start = row_start.copy()
    start[1:size] |= kind[1:] != kind[:-1]
    # A run of white space before more text gives up its last character: a blank joins the next
    # piece, anything else stands alone.
    after = np.flatnonzero(start[1:size] & ~row_start[1:size] & (kind[:-1] == _SPACE)) + 1
    last = after - np.where(data[after - 1] >= 0x80, 2, 1)
    start[last] = True
    start[after[data[after - 1] == 0x20]] = False
    # Contractions begin at an apostrophe that is a run of its own.
    quotes = np.flatnonzero((data == _APOSTROPHE) & start[:size])
    for at in quotes[start[quotes + 1] & ~row_start[quotes + 1]]:
        following = data[at + 1 : at + 3].tobytes()
        if following[:1] in [bytes([x]) for x in _SHORT]:
            length = 2
        elif following in _LONG and not row_start[at + 2]:
            length = 3
        else:
            continue
        start[at + 1] = False
        start[at + length] = True
    return np.flatnonzero(start[:size])


def byte_alphabet() -> dict[int, str]:
    """The characters that byte-level vocabularies are written in: printable bytes stand for themselves, the
    others for the next characters from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + n) for n, b in enumerate(others)}


class Encoder:
    """``path``: a file of the tokenizers library. Its own byte-level splitting is known here; a tokenizer with
    another normalizer or pre-tokenizer encodes every text whole."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.alphabet = byte_alphabet()
        steps = json.loads(self.library.to_str())
        self.added = [token["content"].encode() for token in steps["added_tokens"] if token["content"]]
        split = steps["pre_tokenizer"] or {}
        self.known_steps = (
            steps["normalizer"] is None
            and split.get("type") == "ByteLevel"
            and split.get("use_regex", True)
            and not split["add_prefix_space"]
        )
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.begin = np.zeros(1 << 12, dtype=np.int64)
        self.size = np.zeros(1 << 12, dtype=np.int64)
        self.flat = np.zeros(1 << 14, dtype=np.int32)
        self.used = 0

    def _learn(self, pieces: list[bytes]) -> None:
        encode, alphabet = self.model.tokenize, self.alphabet
        found = [[t.id for t in encode(p.decode("latin-1").translate(alphabet))] for p in pieces]
        ids = np.fromiter(chain.from_iterable(found), dtype=np.int32)
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        first = len(self.place)
        self.place.update(zip(pieces, range(first, first + len(pieces))))
        self.begin = _put(self.begin, first, self.used + np.cumsum(sizes) - sizes)
        self.size = _put(self.size, first, sizes)
        self.flat = _put(self.flat, self.used, ids)
        self.used += len(ids)

    def _split(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        begin = piece_starts(part)
        offsets = np.append(begin, len(part.data)).astype(np.int32)
        data = np.ascontiguousarray(part.data)
        column = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = column.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.place) + len(distinct) > MEMO_PIECES:
            self._forget()
        known = np.fromiter(map(self.place.get, distinct, repeat(-1)), dtype=np.int64, count=len(distinct))
        new = np.flatnonzero(known < 0)
        if len(new):
            known[new] = len(self.place) + np.arange(len(new))
            self._learn([distinct[at] for at in new.tolist()])
        which = known[coded.indices.to_numpy()] if len(begin) else np.zeros(0, dtype=np.int64)
        sizes = self.size[which]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.begin[which] - (ends - sizes), sizes) + np.arange(total)]
        before = np.concatenate([[0], ends])[np.searchsorted(begin, part.starts)]
        return ids, before

    def _holding_added(self, part: Slice) -> np.ndarray:
        """Where contents of added tokens begin; one that crosses into the next row does no harm."""
        data, found = part.data.tobytes(), []
        for content in self.added:
            at = data.find(content)
            while at >= 0:
                found.append(at)
                at = data.find(content, at + 1)
        return np.array(found, dtype=np.int64)

    def encode(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of the slice, one after the other, and where each row's ids begin."""
        if len(part.data) == 0:
            return np.zeros(0, dtype=np.int32), np.zeros(len(part.starts), dtype=np.int64)
        if not self.known_steps:
            found = [self.library.encode(part.text(r).decode(), add_special_tokens=False).ids for r in range(len(part))]
            return np.array([i for ids in found for i in ids], np.int32), np.cumsum([0, *map(len, found)])
        high = np.flatnonzero(part.data >= 0xCA)  # lead bytes from U+0280 on; U+0240 to U+024F is C9
        high = np.concatenate([high, np.flatnonzero(part.data[:-1] == 0xC9)[_beyond(part.data)]])
        whole = np.concatenate([high, self._holding_added(part)])
        if len(whole) == 0:
            return self._split(part)
        strange = np.unique(np.searchsorted(part.starts, whole, side="right") - 1)
        ids, sizes, row = [], np.zeros(len(part), dtype=np.int64), 0
        for odd in [*strange.tolist(), len(part)]:
            if odd > row:
                run = part.starts[row : odd + 1]
                some, before = self.encode(Slice(0, part.data[run[0] : run[-1]], run - run[0]))
                ids.append(some)
                sizes[row:odd] = np.diff(before)
            if odd < len(part):
                some = self.library.encode(part.text(odd).decode(), add_special_tokens=False).ids
                ids.append(np.array(some, dtype=np.int32))
                sizes[odd] = len(some)
            row = odd + 1
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(sizes)])


def _put(kept: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """Write ``values`` from ``at`` on, in a doubled array if they don't fit."""
    if at + len(values) > len(kept):
        kept = np.concatenate([kept, np.zeros(max(len(kept), at + len(values)), dtype=kept.dtype)])
    kept[at : at + len(values)] = values
    return kept


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder for ``path``, so that later tasks find its memory filled."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _beyond(data: np.ndarray) -> np.ndarray:
    """Of the C9 lead bytes, which stand for U+0250 to U+027F."""
    lead = np.flatnonzero(data[:-1] == 0xC9)
    return data[lead + 1] >= 0x90


def with_end(ids: np.ndarray, before: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end_id`` to every row's ids."""
    return np.insert(ids, before[1:], end_id), before + np.arange(len(before))
