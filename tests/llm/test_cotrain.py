import numpy as np
from messy import TEXTS, docs
from pyspark.sql import functions as F

from oligoloom.llm import cotrain as ct


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, text string")


def test_held_out_accuracy(spark):
    """Fit without every third label, then compare with those."""
    sf = "/root/testdata/sf0.01"
    documents, known = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    aside = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0
    scored = ct.score_documents(documents, ct.fit_model(documents, known.where(~aside)))
    kept = scored.select("doc_id", F.col("quality.keep").alias("keep"))
    rows = kept.join(known.where(aside), "doc_id").toPandas()
    good = rows[rows.quality == 1]
    assert good.keep.mean() >= 0.98
    assert (rows.keep == (rows.quality == 1)).mean() >= 0.95
    assert scored.count() == documents.count()


def test_odd_rows_and_labels(spark):
    texts = TEXTS + [(100 + n, f"fine words in a sentence number {n}.") for n in range(30)]
    texts += [(200 + n, "BUY!! NOW!! " * (n + 3)) for n in range(30)]
    given = [(100 + n, 1, "x") for n in range(20)] + [(200 + n, 0, "x") for n in range(20)]
    given += [(100, 1, "x"), (101, None, "x"), (None, 0, "x"), (999, 0, "x")]
    frame = docs(spark, texts)
    scored = ct.score_documents(frame, ct.fit_model(frame, labels(spark, given)))
    rows = scored.collect()
    assert len(rows) == len(texts) and scored.columns == [*frame.columns, "quality"]
    keep = {r.doc_id: r.quality.keep for r in rows}
    assert all(keep[100 + n] for n in range(30)) and not any(keep[200 + n] for n in range(30))
    assert all(0 <= r.quality.score <= 1 for r in rows)


def test_one_id_on_very_many_rows_is_one_sampled_row(spark):
    texts = [(100, f"fine words in a sentence number {n}.") for n in range(3000)] + [(100, None), (7, "BUY!! NOW!! " * 5)]
    frame = docs(spark, texts)
    ids = spark.createDataFrame([(7,), (100,), (8,)], "doc_id long")
    found, views = ct._sampled_features(frame, ids, "doc_id", "text")
    again, same = ct._sampled_features(frame.repartition(7), ids, "doc_id", "text")
    assert found.tolist() == again.tolist() == [7, 100] and [len(v) for v in views] == [2, 2]
    assert all((a == b).all() for a, b in zip(views, same))
    model = ct.fit_model(frame, labels(spark, [(100, 1, "x"), (7, 0, "x")]))
    assert ct.score_documents(frame, model).count() == len(texts)


def test_nothing_to_learn_from(spark):
    frame = docs(spark, TEXTS)
    for given in ([], [(1, 1, "x"), (2, 1, "x")], [(999, 0, "x")]):
        model = ct.fit_model(frame, labels(spark, given))
        assert model is None
        assert ct.score_documents(frame, model).where("quality.keep and quality.score = 1").count() == len(TEXTS)
    assert ct.score_documents(docs(spark, []), None).count() == 0


def test_pseudo_labels_help_the_weak_view():
    """One labelled row a class fools the second view; the first view's sure labels set it right."""
    rnd = np.random.default_rng(0)
    n = 400
    truth = (np.arange(n) % 2).astype(float)
    strong = truth[:, None] * 4 - 2 + rnd.normal(0, 0.3, (n, 1))
    weak = truth[:, None] * 2 - 1 + rnd.normal(0, 1.0, (n, 3))
    few = np.arange(12)
    alone = ct.Logistic(1e-2).fit(weak[few], truth[few])
    model = ct.co_train([strong[few], weak[few]], truth[few], [strong[12:], weak[12:]], ct.Settings(handed=0.2))
    before = ((alone.odds(weak) > 0) == (truth > 0.5)).mean()
    after = ((model.views[1].odds(weak) > 0) == (truth > 0.5)).mean()
    assert after > before


def test_the_page_view_does_not_read_the_text(spark):
    """Rows of one language, source, length and host have one page view, whatever their texts are."""
    rows = [(1, "a b c", "en", "s", 5, "http://A.example/x"), (2, "BUY!! NOW!!\n" * 50, "en", "s", 5, "http://a.example/y?z")]
    rows += [(3, "a b c", None, None, None, None), (4, None, None, None, None, None), (5, "a b c", "de", "s", 5, "http://a.example/")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, url string")
    found, (text, page) = ct._sampled_features(frame, frame.select("doc_id"), "doc_id", "text")
    assert found.tolist() == [1, 2, 3, 4, 5] and page.shape == (5, ct.PAGE_WIDTH) and text.shape == (5, ct.TEXT_WIDTH)
    assert (page[0] == page[1]).all() and (page[2] == page[3]).all() and (page[0] != page[4]).any()
    assert (text[0] == text[2]).all() and (text[0] != text[1]).any()
