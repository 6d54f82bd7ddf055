import itertools
import re
from collections import defaultdict

from messy import TEXTS, docs

from oligoloom.llm import audit


def brute(rows, labels):
    """rows: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    originals = defaultdict(list)
    for i, text, _ in rows:
        if i is not None:
            originals[text or ""].append(i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, t in labels if t == 1 and i is not None}
    parts = defaultdict(list)
    for i, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words))
        fails += "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
        fails += "E" * (i is not None and i > min(originals[text]))
        parts[source or ""].append((set(fails), i in good, i in bad))
    out = []
    for part, members in parts.items():
        steps, shapley = [], defaultdict(int)
        for order in itertools.permutations("ABCDE"):
            for k, letter in enumerate(order):
                before, here = set(order[:k]), set(order[: k + 1])
                removed = [m for m in members if letter in m[0] and not m[0] & before]
                shapley[letter] += len(removed)
                kept = sum(not m[0] & here for m in members)
                redundant = sum(letter in m[0] and bool(m[0] & before) for m in members)
                alone = sum(m[0] == {letter} for m in members)
                lost = [sum(m[1] for m in removed), sum(m[2] for m in removed)]
                steps.append(("".join(order), k + 1, kept, len(removed), redundant, alone, *lost, letter))
        out += [(part, *s[:-1], shapley[s[-1]], s[-1]) for s in steps]
    return sorted(out)


def test_against_brute_force(spark):
    words = " ".join(f"word{n}" for n in range(60))
    texts = TEXTS + [(n, words) for n in range(20, 50)] + [(n, None) for n in range(50, 60)]
    texts += [(60, "UPPER " * 60), (61, words + " #"), (61, words), (62, "same " * 70), (19, words), (19, words)]
    frame = docs(spark, texts)
    labels = [(1, 1, 0), (1, 0, 1), (20, 1, 1), (33, None, 1), (None, 1, 1), (60, 1, None), (61, 1, 1), (999, 1, 1)]
    given = spark.createDataFrame([(*r, 5) for r in labels], "doc_id long, quality int, toxic int, n int")
    found = audit.audit_filters(frame, given)
    rows = [(r.doc_id, r.text, r.source) for r in frame.collect()]
    assert sorted(map(tuple, found.collect())) == brute(rows, labels)


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit_filters(docs(spark, []), labels).count() == 0
    rows = audit.audit_filters(docs(spark, [(1, "One")]), labels).collect()
    assert len(rows) == 600
    assert {(r.kept, r.removed, r.good_lost) for r in rows if r["filter"] == "A"} == {(0, 1, 0), (0, 0, 0)}


def test_other_thresholds(spark):
    at = audit.Thresholds(min_words=1, distinct_percent=0, capital_percent=100, marks="]^-\\")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = audit.audit_filters(docs(spark, [(1, "ONE"), (2, "a ] b"), (3, "a^b"), (4, "# $")]), labels, at)
    removed = defaultdict(int)
    for r in rows.where("step = 1 and filter_order like '%E'").collect():
        removed[r["filter"]] += r.removed
    assert removed == {"A": 0, "B": 0, "C": 0, "D": 6 * 2}
