import corpus_pipeline
from messy import TEXTS, docs
from pyspark.sql import functions as F


def test_stages_on_the_small_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = rows.columns, [rows.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, sf).cache()
        assert rows.columns == columns, name
        counts.append(rows.count())
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4]
    assert rows.where(F.col("text").rlike(r"@mail\d\.example\.com")).count() == 0
    pieces = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in rows.collect()}


def test_stages_on_odd_and_no_rows(spark):
    sf = "/root/testdata/sf0.001"
    for texts in (TEXTS, []):
        rows = docs(spark, texts)
        for name, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, sf)
            found = rows.collect()
            assert found or not texts, name
