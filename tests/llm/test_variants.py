import re
import zlib
from collections import Counter

import pytest
from messy import TEXTS, docs

from oligoloom.llm import variants

NO_DROPS = variants.WordRules(drop_one_of=0)


def word_counts(texts, rules):
    counts = Counter()
    for i, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if rules.drop_one_of and h % rules.drop_one_of == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= rules.least_letters and n >= rules.least_count}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(texts, rules):
    counts = word_counts(texts, rules)
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= rules.ratio * counts[w] else None
    rows = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return sorted(rows)


def found(spark, texts, rules):
    return sorted(map(tuple, variants.spelling_variants(docs(spark, texts), rules).collect()))


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(variants, "_PIECE", 40)
    monkeypatch.setattr(variants, "_COUNTED_WORDS", 7)
    family = ["letter", "leter", "lettter", "lettr", "better", "bettter", "Étoile", "étoile", "etoile", "étoiles"]
    family += ["aaaaa", "aaaaaa", "aaaaab", "abaaaa", "ababab", "bababa", "babab", "×÷×÷×", "×÷×÷"]
    texts = [(n, " ".join(w for k, w in enumerate(family) if n % (k + 1) == 0) + ", x1y") for n in range(1, 60)]
    for rules in (variants.WordRules(), NO_DROPS, variants.WordRules(4, 1, 3)):
        assert found(spark, texts + TEXTS, rules) == brute(texts + TEXTS, rules)


def test_words_around_the_length_where_prefixes_are_hashed(spark):
    size = variants.HASHED_FROM
    base = ("abcdefghij" * 20)[: size + 3]
    words = [base[:n] for n in range(size - 3, size + 3)]
    words += [w[:5] + "z" + w[6:] for w in words] + [w[:-1] + "zz" for w in words]
    texts = [(k, " ".join([w] * (2 ** (k % 5) + 2))) for k, w in enumerate(words)]
    assert found(spark, texts, NO_DROPS) == brute(texts, NO_DROPS)


def test_a_very_long_word_and_empty_tables(spark):
    long = "lettersandletters" * 2000
    texts = [(1, f"{long} {long} {long}"), (2, f"{long}s {long}s {long}s {long}s {long}s {long}s")]
    rows = found(spark, texts, NO_DROPS)
    assert [(r[3], r[4], r[5]) for r in rows] == [(3, 1, 6), (6, 1, None)]
    assert found(spark, [], NO_DROPS) == []
    assert found(spark, [(1, None), (2, "")], NO_DROPS) == []


@pytest.mark.parametrize("word", ["abcab", "aaaaa", "x" * 70])
def test_rotations_tell_every_place_apart(spark, word):
    prefixes = variants._prefixes(word)
    hashed = variants._hashed_prefixes(word)
    assert len(prefixes) == len(hashed) == 2 * len(word) + 1
    same = lambda names: [names.index(p) for p in names]
    assert same(prefixes) == same(hashed)
