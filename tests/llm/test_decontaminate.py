import duckdb
import pytest
from messy import LONG, TEXTS, docs

from oligoloom.llm import decontaminate as de
from oligoloom.llm.queries import ORACLE_SQL, QUERIES

TEN = "alpha beta gamma delta epsilon zeta eta theta iota kappa"


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, n long")


@pytest.mark.parametrize("set_bytes", [de.SET_BYTES, 40])
def test_hits_of_long_short_repeated_and_odd_items(spark, set_bytes):
    texts = [
        *TEXTS,
        (20, f"Before {TEN.upper()}, lambda; after"),
        (21, f"{TEN} lambda and short item too"),
        (22, "alpha beta gamma delta epsilon zeta eta theta iota"),
    ]
    bench = items(
        spark,
        [(1, f"{TEN} lambda", 0), (2, "Short, item!", 0), (2, "short item", 0), (3, None, 0), (4, "...", 0)]
        + [(10, TEN, 0), (None, "no id here", 0)],
    )
    found = de.contamination(docs(spark, texts), bench, set_bytes=set_bytes)
    got = {}
    for row in found.collect():
        got.setdefault(row.doc_id, []).append(row.contamination)
    assert (got[20][0].n_hit, got[20][0].items) == (11, ["1", "10"])
    assert (got[21][0].n_words, got[21][0].n_hit, got[21][0].items) == (15, 13, ["1", "10", "2"])
    assert [(s.begin, s.end) for s in got[21][0].spans] == [(0, 11), (12, 14)]
    assert (got[22][0].n_hit, got[22][0].items) == (0, [])
    assert sorted((r.n_words, r.n_hit) for r in got[None]) == [(0, 0), (5, 3)]
    assert got[4][0].n_words == len(LONG.split()) and len(got[5]) == 2 and got[2][0].n_words == 0
    kept = {r.doc_id: r.text for r in de.without_spans(found).collect()}
    assert kept[20] == "Before ; after" and kept[21] == " and  too" and kept[4] == LONG and kept[2] is None
    assert found.drop("contamination").columns == docs(spark, []).columns


def test_empty_tables(spark):
    assert de.clean_documents(docs(spark, []), items(spark, [(1, TEN, 0)])).count() == 0
    assert de.clean_documents(docs(spark, TEXTS), items(spark, [])).count() == len(TEXTS)
    assert de.clean_documents(docs(spark, TEXTS), items(spark, [(1, "one short text", 0)])).count() == len(TEXTS) - 3


def test_query_against_sql(spark):
    name, sf = "op4_window_decontamination", "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    rows = QUERIES[name](spark, sf)
    expected = con.execute(f"SELECT {', '.join(rows.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, rows.collect())) == sorted(expected)
