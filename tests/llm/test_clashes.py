"""Columns of the documents that have the names of an operator's own."""

import corpus_pipeline
from messy import TEXTS, docs
from pyspark.sql import functions as F

from oligoloom.llm import decontaminate, forest, surrogates
from oligoloom.llm.tables import own_names

NAMES = ("found", "key", "new", "entities_here", "leads", "digest", "row", "hit", "quality", "entities", "contamination")
LETTER = "Write to someone at a.person@mail7.example.com or call +1 (555) 123-4567 about the five boxing wizards today."


def clashing(spark, texts):
    return docs(spark, texts).select("*", *[F.lit("mine").alias(f"__{n}") for n in NAMES], F.lit(1).alias("___found"))


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_own_names(spark):
    assert own_names(docs(spark, []), "key", "row") == ["__key", "__row"]
    assert own_names(clashing(spark, []), "key") == ["____key"]


def test_results_do_not_depend_on_other_columns(spark):
    texts = [*TEXTS, (11, LETTER), (12, LETTER), (12, "an unrelated text of some words that nobody else has")]
    items = spark.createDataFrame([(1, "quick brown fox jumps over lazy dogs near 42 rivers")], "item_id long, text string")
    plain, odd = docs(spark, texts), clashing(spark, texts)
    for run in (
        lambda d: surrogates.replace_entities(d, "secret"),
        lambda d: forest.without_duplicates(d),
        lambda d: decontaminate.clean_documents(d, items),
        lambda d: decontaminate.contamination(d, items, set_bytes=1),
    ):
        found, want = run(odd), run(plain)
        assert set(odd.columns) <= set(found.columns)
        assert rows(found.select(want.columns)) == rows(want)
        assert found.where("__key = 'mine' and __found = 'mine' and ___found = 1").count() == found.count()


def test_stages_keep_all_columns(spark):
    frame = clashing(spark, [*TEXTS, (11, LETTER)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame_after = stage(spark, frame, "/root/testdata/sf0.001")
        assert frame_after.columns == frame.columns, name
        assert frame_after.where("__quality = 'mine' and __entities = 'mine'").count() == frame_after.count() > 0
