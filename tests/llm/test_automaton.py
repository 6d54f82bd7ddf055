import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from messy import TEXTS, docs

from oligoloom.llm import automaton as au

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_force(texts):
    rows = [(i, [*WORD.findall((t or "").encode().lower()), None]) for i, t in texts]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    words, pairs, states = Counter(), Counter(), Counter()
    for (_, w), h in zip(rows, held):
        if not h:
            words.update(w)
            pairs.update(zip(["start", *w], w))
            states.update(["start", *w[:-1]])
    n, v, once = sum(words.values()), len(words), sum(c == 1 for c in words.values())
    bins = np.zeros(256)
    for c in words.values():
        bins[math.floor(4 * math.log2(c))] += 1
    beta, unknown = au.fit_beta(bins, len(pairs)), (once + 1) / (n + once + 1)

    def chance(state, w):
        root = (1 - unknown) * words[w] / n if words[w] else unknown
        c = states[state]
        k = c**beta if c else 1.0
        return (pairs[state, w] + k * root) / (c + k)

    return [
        (
            i,
            h,
            len(w),
            sum(words[x] > 0 for x in w),
            n,
            sum(math.log10((words[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w),
            sum(math.log10(chance(s, x)) for s, x in zip(["start", *w], w)),
        )
        for (i, w), h in zip(rows, held)
    ]


def test_squeezed_numbers():
    for values in ([], [0], [5, 5, 7], [2**64 - 1, 0, 300]):
        array = np.array(values, dtype=np.uint64)
        assert au.unsqueeze(au.squeeze(array)).tolist() == values
        assert au.unsqueeze_rising(au.squeeze_rising(np.sort(array))).tolist() == sorted(values)


@pytest.mark.parametrize("chunk_tokens", [5, 2_000_000])
def test_scores(spark, chunk_tokens):
    texts = TEXTS + [(n, f"word{n % 7} and word{n % 3} then Word{n % 7} AND word{n}") for n in range(40, 90)]
    found = [tuple(r) for r in au.score_texts(docs(spark, texts), chunk_tokens=chunk_tokens).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
    for got, want in zip(sorted(found, key=key), sorted(brute_force(texts), key=key), strict=True):
        assert got[:5] == want[:5]
        assert got[5:] == pytest.approx(want[5:], rel=1e-9)


def test_the_automaton_sums_to_one():
    """From any state the arcs of all known words and of the unknown class add up to one."""
    words, pairs = np.array([5, 3, 1, 1]), np.array([2, 1, 0, 0])
    n, unknown, c, k = words.sum(), 3 / 13, 5, 5**0.8
    root = np.append((1 - unknown) * words / n, unknown)
    assert ((np.append(pairs, 0) + k * root) / (pairs.sum() + 2 + k)).sum() + 2 / (5 + k) == pytest.approx(1)
    assert c == pairs.sum() + 2


def test_no_training_texts_and_no_texts(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    rows = au.score_texts(docs(spark, [(i, "some words") for i in held])).collect()
    assert [(r.n_known, r.train_tokens, r.base_score, r.score) for r in rows] == [(0, 0, 0.0, 0.0)] * 3
    assert au.score_texts(docs(spark, [])).count() == 0
