"""Spelling variants by permuterm rotations: words one edit apart, and the form that a variant leads to.

Words. Texts are cut into runs of letters; A-Z are lower-cased. A run that the rule ``dropped`` picks loses one letter
(the simulated misprint of the query). Each task counts the words of its texts and hands partial counts on whenever
they become many; words with enough letters and occurrences form the vocabulary, ranked by falling count, then by
code points, so that of two words the better form has the smaller rank.

Neighbours. A word is marked with a terminator, ``word$``, and rotated. Put the letter to be edited last: ``x c y``
becomes ``y $ x c``, and its prefix ``y $ x`` skips the letter. All words that differ from it in that letter alone have
rotations with the same prefix, and the word ``x y`` has the rotation ``y $ x`` itself. Rotations are sorted into
ranges of their prefixes; in a scan the words of one prefix follow each other: at most one word without the letter
and one for each letter of the alphabet (90), so groups are bounded however frequent a word is. A scan emits for each
word of a group how many neighbours it has there and the smallest rank among them, from the group's two smallest;
pairs are never listed. Deleting any letter of a run of equal letters gives the same word, so only the first of
such a run counts as an insertion or deletion; a replacement belongs to one place anyway.

Rotations of a word take the square of its length. From ``HASHED_FROM`` letters on a prefix is therefore written as a
pair of polynomial hashes (about 122 bits) that follow from one another in constant time.

Forms. The neighbour of smallest rank is a word's form if it occurs at least ``ratio`` times as often. Counts at least
double from form to form, so a chain is short, and roots are found by doubling pointers: 6 joins at most.

Null texts have no words; a null id counts as an empty text in the rule. Very long texts are read in pieces that end
between words. Repeated rows count as often as they occur; ties between forms go to the smaller code points; other
columns play no part; an empty table gives no words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oligoloom.llm.tables import stored

HASHED_FROM = 64
# Different words that a task counts before it hands them on, and bytes of text cut into words at a time.
_COUNTED_WORDS = 200_000
_PIECE = 1 << 20
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_NO_LETTER = re.compile(rb"[\x00-\x60\x7b-\x7f]")
_TERMINATOR = "$"
_WHOLE, _FIRST_OF_RUN, _LATER = 0, 1, 2


@dataclass(frozen=True)
class WordRules:
    """Words need ``least_letters`` code points and ``least_count`` occurrences. A run whose crc32 of
    ``<doc_id>:<run>`` is divisible by ``drop_one_of`` loses a letter (0: none does)."""

    least_letters: int = 5
    least_count: int = 3
    drop_one_of: int = 97
    ratio: int = 2


def _pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        gap = _NO_LETTER.search(text, at + _PIECE) if at + _PIECE < len(text) else None
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def _without_letter(word: bytes, crc: int) -> bytes:
    letters = word.decode()
    place = crc % len(letters)
    return (letters[:place] + letters[place + 1 :]).encode()


def count_words(docs: DataFrame, rules: WordRules, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words long and frequent enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            known = [(w.decode(), n) for w, n in counts.items() if n and w]
            counts.clear()
            words, numbers = zip(*known) if known else ((), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array(numbers, pa.int64())], names=["word", "n"]
            )

        for batch in batches:
            for name, value in zip(*batch.columns):
                if not value.is_valid:
                    continue
                start = zlib.crc32(f"{name.as_py()}:".encode() if name.is_valid else b":")
                # bytes.lower() changes A-Z only.
                for piece in _pieces(value.as_buffer().to_pybytes().lower()):
                    found = _RUN.findall(piece)
                    counts.update(found)
                    if rules.drop_one_of:
                        crc = zlib.crc32
                        for word in [w for w in found if not crc(w, start) % rules.drop_one_of]:
                            counts[word] -= 1
                            counts[_without_letter(word, crc(word, start))] += 1
                    if len(counts) >= _COUNTED_WORDS:
                        yield flush()
        yield flush()

    texts = docs.select(F.col(doc).cast("string"), F.col(text).cast("string"))
    parts = texts.mapInArrow(run, "word string, n long")
    words = parts.where(F.length("word") >= rules.least_letters).groupBy("word").agg(F.sum("n").alias("n"))
    return words.where(F.col("n") >= rules.least_count)


def ranked(words: DataFrame) -> DataFrame:
    """(word, n, rank): ranks rise with falling count, and inside one count with the code points; they leave gaps."""
    order = [F.desc("n"), F.asc("word")]
    ordered = words.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(ordered.withColumn("rank", F.monotonically_increasing_id()), "words")


def _hashed_prefixes(word: str) -> list[str]:
    """What ``_prefixes`` gives, each as two polynomial hashes of its letters."""
    mods = (2**61 - 1, 2**63 - 25)
    bases = (0x1F3D5B79A7C9E1, 0x2B4D6F81A3C5E7)
    codes = [ord(c) for c in word]
    size = len(codes)
    hashed = []
    for mod, base in zip(mods, bases):
        power, head = [1], [0]
        for code in codes:
            power.append(power[-1] * base % mod)
            head.append((head[-1] * base + code) % mod)
        mark = ord(_TERMINATOR)

        def joined(first: int, last: int, power=power, head=head, mod=mod, base=base, mark=mark) -> int:
            """Hash of the letters from ``first`` on, the terminator, and the letters before ``last``."""
            tail = (head[size] - head[first] * power[size - first]) % mod
            return ((tail * base + mark) * power[last] + head[last]) % mod

        hashed.append((joined, size))
    whole = [":".join(f"{h(i, i):x}" for h, _ in hashed) for i in range(size + 1)]
    skipped = [":".join(f"{h(i + 1, i):x}" for h, _ in hashed) for i in range(size)]
    return whole + skipped


def _prefixes(word: str) -> list[str]:
    """The rotations of the marked word, then those prefixes that skip letter 0, 1, ..."""
    marked = word + _TERMINATOR
    whole = [marked[i:] + marked[:i] for i in range(len(marked))]
    return whole + [marked[i + 1 :] + marked[:i] for i in range(len(word))]


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, kind, rank): every rotation of a word, whole and with its last letter skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes: list[str] = []
            kinds: list[int] = []
            ranks: list[int] = []
            for word, rank in zip(*(c.to_pylist() for c in batch.columns)):
                size = len(word)
                own = [_WHOLE] * (size + 1)
                own += [_LATER if i and word[i] == word[i - 1] else _FIRST_OF_RUN for i in range(size)]
                plain = _prefixes(word) if size < HASHED_FROM else []
                coded = _hashed_prefixes(word) if size >= HASHED_FROM - 1 else []
                if plain:
                    # The longest word in plain letters meets words with one letter more by its whole rotations.
                    coded = coded[: size + 1]
                prefixes += plain + coded
                kinds += own[: len(plain)] + own[: len(coded)]
                ranks += [rank] * (len(plain) + len(coded))
                if len(prefixes) >= 50_000:
                    yield _rotation_batch(prefixes, kinds, ranks)
                    prefixes, kinds, ranks = [], [], []
            if prefixes:
                yield _rotation_batch(prefixes, kinds, ranks)

    return words.select("word", "rank").mapInArrow(run, "prefix string, kind int, rank long")


def _rotation_batch(prefixes: list[str], kinds: list[int], ranks: list[int]) -> pa.RecordBatch:
    columns = [pa.array(prefixes, pa.string()), pa.array(kinds, pa.int32()), pa.array(ranks, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["prefix", "kind", "rank"])


_NONE = np.iinfo(np.int64).max


def _two_least(values: np.ndarray, starts: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two smallest values of each group of consecutive rows; values of a group differ, but for ``_NONE``."""
    least = np.minimum.reduceat(values, starts)
    rest = np.where(values == least[group], _NONE, values)
    return least, np.minimum.reduceat(rest, starts)


def scan_groups(starts: np.ndarray, kind: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row its number of neighbours in its group and the smallest rank among them (``_NONE``: none)."""
    sizes = np.diff(np.append(starts, len(kind)))
    group = np.repeat(np.arange(len(starts)), sizes)
    whole, first = kind == _WHOLE, kind == _FIRST_OF_RUN
    n_whole, n_first = np.add.reduceat(whole.astype(np.int64), starts), np.add.reduceat(first.astype(np.int64), starts)
    letters = sizes - n_whole
    near = np.where(whole, n_first[group], letters[group] - 1 + np.where(first, n_whole[group], 0))
    least, second = _two_least(np.where(whole, _NONE, rank), starts, group)
    best = np.where(rank == least[group], second[group], least[group])
    shorter = np.minimum.reduceat(np.where(whole, rank, _NONE), starts)[group]
    best = np.where(first, np.minimum(best, shorter), best)
    longer = np.minimum.reduceat(np.where(first, rank, _NONE), starts)[group]
    return near, np.where(whole, longer, best)


def neighbours(sorted_rotations: DataFrame) -> DataFrame:
    """(rank, n_near, best) once per word and group with neighbours; rows of a prefix must follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def scanned(rows: pa.Table) -> pa.RecordBatch:
            prefix = rows.column("prefix").combine_chunks().dictionary_encode().indices.to_numpy()
            starts = np.flatnonzero(np.diff(prefix, prepend=-1))
            rank = rows.column("rank").to_numpy()
            near, best = scan_groups(starts, rows.column("kind").to_numpy(), rank)
            at = near > 0
            columns = [pa.array(rank[at]), pa.array(near[at]), pa.array(best[at])]
            return pa.RecordBatch.from_arrays(columns, names=["rank", "n_near", "best"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
            prefix = rows.column("prefix")
            last = prefix[len(rows) - 1].as_py()
            cut = len(rows) - 1
            while cut and prefix[cut - 1].as_py() == last:
                cut -= 1
            if cut:
                yield scanned(rows.slice(0, cut))
            held = rows.slice(cut)
        if held is not None and len(held):
            yield scanned(held)

    return sorted_rotations.mapInArrow(run, "rank long, n_near long, best long")


def roots(forms: DataFrame) -> DataFrame:
    """(rank, root) of every word with a form, by doubling pointers: chains have at most 63 links."""
    paths = stored(forms.select("rank", F.col("form").alias("root")), "roots")
    while True:
        ahead = paths.select(F.col("rank").alias("root"), F.col("root").alias("further"))
        longer = stored(paths.join(ahead, "root", "left"), "roots")
        if longer.where("further is not null").isEmpty():
            return paths
        paths = longer.select("rank", F.coalesce("further", "root").alias("root"))


def spelling_variants(
    docs: DataFrame, rules: WordRules = WordRules(), doc: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary."""
    words = ranked(count_words(docs, rules, doc, text))
    turned = stored(rotations(words), "rotations")
    ordered = turned.repartitionByRange("prefix").sortWithinPartitions("prefix")
    near = neighbours(ordered).groupBy("rank").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    known = words.select(F.col("rank").alias("best"), F.col("word").alias("best_word"), F.col("n").alias("best_n"))
    rows = words.join(near, "rank", "left").join(known, "best", "left")
    is_form = F.col("best_n") >= F.col("n") * rules.ratio
    rows = stored(
        rows.select(
            "rank",
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("best")).alias("form_rank"),
            F.when(is_form, F.col("best_word")).alias("form"),
            F.when(is_form, F.col("best_n")).alias("form_n"),
        ),
        "variants",
    )
    found = roots(rows.where("form_rank is not null").select("rank", F.col("form_rank").alias("form")))
    top = words.select(F.col("rank").alias("root"), F.col("word").alias("root_word"))
    rows = rows.join(found, "rank", "left").join(top, "root", "left")
    return rows.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
