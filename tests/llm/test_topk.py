import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from oligoloom.llm import topk
from oligoloom.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "vec_id long, embedding array<float>, score long, rank int, v string"


def brute_force(rows, k):
    good = [
        (i, [math.floor(64 * float(np.float32(x))) for x in v])
        for i, v, *_ in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, a in good:
        if q % 20 == 0:
            scores = [(-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(a) == len(b)]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def search(spark, rows, k=20):
    frame = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, topk.top_k(frame, F.col("vec_id") % 20 == 0, k).collect()))


@pytest.mark.parametrize("block", [16, 8192])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    rnd = np.random.default_rng(1)
    vectors = rnd.normal(0, 0.2, (300, 8)).round(2).tolist()
    rows = [(i, v, 0, 0, "x") for i, v in enumerate(vectors)] + [(300 + i, vectors[20], 0, 0, "x") for i in range(60)]
    assert search(spark, rows) == brute_force(rows, 20)


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, -1.0], 0, 0, "x"),
        (20, [0.5, 0.5], 0, 0, "x"),
        (20, [0.5, 0.5], 0, 0, "x"),
        (1, [1.0, None], 0, 0, "x"),
        (2, [float("nan"), 1.0], 0, 0, "x"),
        (3, [float("inf"), 1.0], 0, 0, "x"),
        (4, None, 0, 0, "x"),
        (None, [1.0, 1.0], 0, 0, "x"),
        (5, [1.0, 1.0, 1.0], 0, 0, "x"),
        (6, [3e5, -3e5], 0, 0, "x"),
        (7, [-1.0, 1.0], 0, 0, "x"),
        (40, [], 0, 0, "x"),
        (8, [], 0, 0, "x"),
    ]
    assert search(spark, rows) == brute_force(rows, 20)
    assert search(spark, rows, 1) == brute_force(rows, 1)
    assert search(spark, []) == [] and search(spark, [(1, [1.0], 0, 0, "x")]) == []


@pytest.mark.parametrize("scale", [(1.0, 1.0), (9.0, 9.0)])
def test_bounds_hold_at_every_level(scale):
    rnd = np.random.default_rng(4)
    data, weights = rnd.integers(-9, 9, (50, 6)).astype(float), rnd.integers(-9, 9, (5, 6)).astype(float)
    reading = topk.Reading(topk.Lists(np.arange(50), data), weights, np.float64, scale)
    exact = weights @ data.T / (scale[0] * scale[1])
    for level in range(topk.LEVELS):
        lower, upper = reading.read(level)
        assert (lower <= exact + 1e-9).all() and (exact <= upper + 1e-9).all()
    assert np.allclose(lower, exact) and np.allclose(upper, exact)


def test_runs_behind_the_end_stay_unread(monkeypatch):
    """Twenty candidates stand out: one run of every list settles them."""
    data = np.ones((400, 6))
    data[:20] = 1000.0
    read = []
    run = topk.Lists.run
    monkeypatch.setattr(topk.Lists, "run", lambda self, level, top: read.append(level) or run(self, level, top))
    found = list(topk.search_block(np.array([999]), np.ones((1, 6)), topk.Lists(np.arange(400), data), 20))
    assert set(read) == {0} and sorted(found[0][2]) == list(range(20))


@pytest.mark.parametrize("size", [4e7, 1e9, 1e12, 3e38])
def test_large_components(spark, size):
    """Against whole numbers, and as far as doubles reach against the query's SQL."""
    rnd = np.random.default_rng(2)
    vectors = [(rnd.integers(-9, 9, 4) * size / 9).tolist() for _ in range(60)] + [[1.0, 2.0, 3.0, 4.0]] * 3
    rows = [(i, v, 0, 0, "x") for i, v in enumerate(vectors)]
    long = (1 << 63) - 1
    want = [(q, i, max(-long - 1, min(long, s))) for q, _, i, s in brute_force(rows, 100)]
    want = {q: sorted(((-s, i) for p, i, s in want if p == q))[:20] for q in (0, 20, 40, 60)}
    assert search(spark, rows) == [(q, n + 1, i, -s) for q, best in want.items() for n, (s, i) in enumerate(best)]


def test_large_components_against_sql(spark):
    rows = [(i, [4e7, 1e7] if i in (1, 20) else [float(i), 1.0], 0, 0, "x") for i in (0, 1, 2, 20)]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [r[:2] for r in rows])
    sql = ORACLE_SQL["op3_sorted_list_topk"]
    assert search(spark, rows) == sorted(con.execute(f"SELECT query_id, rank, vec_id, score FROM ({sql})").fetchall())


def test_query_against_sql(spark):
    name, sf = "op3_sorted_list_topk", "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    rows = QUERIES[name](spark, sf)
    expected = con.execute(f"SELECT {', '.join(rows.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, rows.collect())) == sorted(expected)
