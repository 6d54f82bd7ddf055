import random
import re

import numpy as np
import pytest
from messy import TEXTS, docs

from oligoloom.llm import forest

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def brute_force(texts, threshold=0.8):
    """{row: (class id, links, copies)} by comparing all pairs."""
    rows = [(i, WORD.findall((t or "").encode().lower())) for i, t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for _, w in rows]
    links = [set() for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None:
                both = len(sets[a] & sets[b])
                if both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                    links[a].add(b)
                    links[b].add(a)
    out = []
    for a, (name, w) in enumerate(rows):
        group, new = {a}, {a}
        while new:
            new = {c for b in new for c in links[b]} - group
            group |= new
        copies = sum(1 for n, v in rows if v == w and n is not None) if w and name is not None else 1
        out.append((name, min((rows[b][0] for b in group), default=None) if name is not None else None, len(links[a]), copies))
    return out


def ordered(rows):
    return sorted((tuple((v is not None, v or 0) for v in r) for r in rows))


def family(seed, size, words=120, edits=2):
    rnd = random.Random(seed)
    base = [f"w{rnd.randint(0, 10**6)}" for _ in range(words)]
    for _ in range(size):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(len(w))] = f"x{rnd.randint(0, 10**6)}"
        yield " ".join(w)


def check(spark, texts):
    found = forest.near_duplicates(docs(spark, texts)).collect()
    assert ordered(map(tuple, found)) == ordered(brute_force(texts))


def test_odd_rows(spark):
    check(spark, TEXTS + [(30, "same words, few"), (31, "Same words... few!"), (32, "same words few more")])


def test_families_of_near_copies(spark):
    texts = [t for seed in range(6) for t in family(seed, 12, edits=4)]
    check(spark, [(n * 3 % 1000, t) for n, t in enumerate(texts)])


def test_large_nodes_are_split(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK_DOCS", 8)
    check(spark, list(enumerate([*family(1, 60), *family(2, 40), *family(1, 10)])))


def test_empty_table_and_duplicates_removed(spark):
    assert forest.near_duplicates(docs(spark, [])).count() == 0
    assert forest.without_duplicates(docs(spark, [])).count() == 0
    texts = list(enumerate(family(4, 20, edits=1))) + [(90, "alone"), (91, None), (None, "alone"), (0, next(family(4, 1)))]
    rows = forest.without_duplicates(docs(spark, texts))
    left = [r.doc_id for r in rows.collect()]
    leaders = {c for _, c, _, _ in brute_force(texts) if c is not None}
    assert set(left) == leaders | {None} and rows.columns == docs(spark, []).columns


def test_one_row_of_each_group_stays_when_ids_hold_several_texts(spark):
    a, b, c, d = (next(family(seed, 1, edits=0)) for seed in (11, 12, 13, 14))
    near = d.split()[:-1] + ["other"]
    texts = [(1, a), (5, a), (5, b), (9, b), (6, c), (6, c), (6, None), (6, None), (7, d), (7, " ".join(near)), (8, d)]
    texts += [(20, a), (20, b), (None, a), (3, "x y"), (3, "x, y!"), (2, "lone words"), (2, "other words")]
    left = [(r.doc_id, r.text) for r in forest.without_duplicates(docs(spark, texts)).collect()]
    assert len([x for x in left if x[0] == 7]) == 1
    # "x y" and "x, y!" have equal words; the smaller text stays.
    kept = [(1, a), (5, b), (6, c), (6, None), (None, a), (3, "x y"), (2, "lone words"), (2, "other words")]
    assert sorted(map(str, (x for x in left if x[0] != 7))) == sorted(map(str, kept))


@pytest.mark.parametrize("similarity", [0.8, 0.9])
def test_recall_of_the_node_level(similarity):
    level = forest.node_level(0.8)
    assert forest.meeting_chance(similarity, level) >= forest.RECALL
    assert forest.meeting_chance(0.8, level + 1) < forest.RECALL


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    labels = {r.v: r.label for r in forest.components(edges).collect()}
    assert labels == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_common_counts_in_column_chunks(monkeypatch):
    monkeypatch.setattr(forest, "_COLUMNS_AT_ONCE", 7)
    rnd = np.random.default_rng(2)
    sets = [np.unique(rnd.integers(0, 60, 30)).astype(np.uint64) for _ in range(9)]
    common = forest.common_counts(sets)
    for a in range(9):
        for b in range(9):
            if a != b:
                assert common[a, b] == len(np.intersect1d(sets[a], sets[b]))
