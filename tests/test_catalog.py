"""Every registered query at the smallest scale, against DuckDB where there is SQL for it."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as contract  # noqa: E402
from oligoloom import catalog  # noqa: E402
from oligoloom.catalog import QUERIES  # noqa: E402
from oligoloom.operators.prune import independent_set  # noqa: E402
from oligoloom.storage import materialize  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float) and math.isfinite(value):
        return round(value, 4)
    return value


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(([plain(row[i]) for i in order] for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, duck, name):
    frame = contract.queries()[name](spark, SF_DIR)
    rows = frame.collect()
    if name not in contract.oracle_sql():
        assert rows
        return
    result = duck.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert sorted_rows(frame.columns, rows) == sorted_rows(columns, result.fetchall())


@pytest.mark.parametrize("name", ["final_oligos", "mis_survivors", "mis_survivors_rounds", "trimmed_oligos", "delivery_order"])
def test_pruning_reads_pairs_of_indexes(spark, monkeypatch, tmp_path, name):
    """No wide table of conflicts is written for a query that only prunes."""
    spark.range(1200).withColumnRenamed("id", "o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    folder = str(tmp_path)
    rules = catalog.RULES if name == "final_oligos" else catalog.DENSE_RULES
    pool = catalog.accepted(spark, folder)
    wide = independent_set(pool, materialize(catalog.co.conflict_edges(pool, rules), "wide"))
    want = {r.sequence for r in wide.collect()}
    monkeypatch.setattr(catalog.co, "conflict_edges", None)
    assert {r.sequence for r in QUERIES[name](spark, folder).collect()} == want and len(want) < 500


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.columns == ["sequence", "reverse_complement", "gc_fraction", "intrinsic_tm_c"]
    assert frame.count() == 187


@pytest.mark.parametrize("missing", ["tokenizers", "public_tokenizers"])
def test_entry_without_an_optional_package(missing):
    code = f"import sys; sys.modules['{missing}'] = None; import __spark_entry__ as e; print(len(e.queries()))"
    root = os.path.dirname(contract.__file__)
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True)
    assert int(done.stdout) == len(QUERIES)
    try:
        import oligoloom.llm  # noqa: F401
    except ModuleNotFoundError:
        return
    assert f"no package {missing}" in done.stderr


def test_oracles_belong_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
