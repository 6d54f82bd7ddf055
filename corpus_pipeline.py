"""A cleaning pipeline over ``documents``: each stage calls one operator of ``oligoloom.llm``.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame; all but
the last return the columns of ``documents``. Stages are written as Parquet and read again by the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oligoloom.llm import cotrain, decontaminate, forest, packing, surrogates
from oligoloom.llm.queries import SURROGATE_SECRET, table, tokenizer_path
from oligoloom.llm.tables import own_names, stored

# The fitted classifier and the packing's local search have no SQL form.
ORACLE_SQL = None


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the co-trained classifier rejects."""
    model = cotrain.fit_model(docs, table(spark, sf_dir, "labels"))
    [report] = own_names(docs, "quality")
    return cotrain.score_documents(docs, model, report=report).where(f"{report}.keep").drop(report)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of every near-duplicate group; rows without an id all stay."""
    return forest.without_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a ten-word window of a benchmark item."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put surrogates in the place of personal data; lengths follow the new texts."""
    [counter] = own_names(docs, "entities")
    replaced = surrogates.replace_entities(docs, SURROGATE_SECRET, counter=counter)
    if "n_chars" in docs.columns:
        length = F.when(F.col(counter) > 0, F.length("text")).otherwise(F.col("n_chars"))
        replaced = replaced.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return replaced.drop(counter)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents, packed into sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path(), end_id=0, capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", reject_low_quality),
    ("near-duplicates", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("personal-data", replace_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
