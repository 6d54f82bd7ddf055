import pytest
from plain import conflicts, random_pool
from pyspark.sql import functions as F

from oligoloom.operators.conflicts import PairRules
from oligoloom.operators.key_index import KeyIndex
from oligoloom.sources.files import manifests
from oligoloom.sources.shared import names, remove, write_text

RULES = PairRules(12, -20.0, min_run=4)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "idx long, sequence string")


def edges(rows):
    return sorted((r.left_index, r.right_index) for r in rows.collect())


def test_batches_probe_what_is_left(spark, tmp_path):
    texts = random_pool(90, 12, 5)
    pool = frame(spark, texts)
    want = {e: t for e, t in conflicts(texts, 3, 4, 0, -20.0).items()}
    index = KeyIndex(spark, str(tmp_path / "index"), RULES, buckets=5)
    assert index.postings().count() == 0 and edges(index.conflicts(pool)) == []
    batches = [pool.where(F.col("idx").between(30 * n, 30 * n + 29)) for n in range(3)]
    found = []
    for n, batch in enumerate(batches):
        index.append(batch, n)
        index.append(batch, n)  # a repeated batch overwrites its own folder
        found += edges(index.conflicts(batch, through=n))
    assert sorted(found) == sorted(want)
    # What is removed is found no more, before and after compaction, and by batches that come later.
    index.remove(pool.where("idx % 4 = 0"), 2)
    left = sorted(e for e in want if e[1] >= 60 and e[0] % 4)
    for _ in range(2):
        assert edges(index.conflicts(batches[2])) == left
        index.compact()
    assert {r.left_index % 4 for r in index.postings().select("left_index").collect()} == {1, 2, 3}
    assert names(spark, str(tmp_path / "index")) == ["generation-2"]


def test_a_broken_compaction_leaves_the_old_generation(spark, tmp_path):
    folder = str(tmp_path / "index")
    index = KeyIndex(spark, folder, RULES, buckets=3)
    index.append(frame(spark, random_pool(20, 12, 1)), 0)
    before = index.postings().count()
    index.postings().limit(1).write.parquet(f"{folder}/generation-1/postings/batch=-1")
    remove(spark, f"{folder}/generation-1/postings/batch=-1/_SUCCESS")
    assert before and index.postings().count() == before
    index.compact()
    assert index.postings().count() == before


@pytest.mark.parametrize("text", ["{}", "new"])
def test_the_newest_whole_manifest_counts(spark, tmp_path, text):
    folder = str(tmp_path)
    write_text(spark, f"{folder}/manifest-000000002.json", text)
    write_text(spark, f"{folder}/manifest-000000010.json", text)
    (tmp_path / "manifest-000000011.json.new").write_text("half")
    assert manifests(spark, folder)[-1] == "manifest-000000010.json"
