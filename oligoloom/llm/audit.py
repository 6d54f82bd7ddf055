"""Filter interaction audit: what each of five filters removes, in every order of application.

Every document gets five bits, one for each filter that it fails (A too few words, B too few different words, C too
many capitals, D special characters, E a copy of an earlier text). Documents with the same part, bits and labels
behave alike in every order, so the corpus shrinks to mask cells (part, bits) with counts. A recursive CTE
enumerates the orders: it starts from the empty prefix joined with the 32 possible mask cells and extends each prefix
by every letter that it does not hold yet, carrying the bits of the filters applied so far; each level emits what its
step does to every cell: kept, removed, redundant. It ends at all orders with 10,432 rows whatever the corpus, is
broadcast, and weighs the counted cells. A prefix is evaluated once and shared by all orders that begin with it.

Copies: E is decided per text over the whole table by the SHA-256 of the text. Rows of equal text and id are combined
before the shuffle, the smallest id of a text is an aggregate, and the lookup goes by text and id, so no text, id or
part brings its rows together in one task.

Null texts are empty (and copies of each other); null parts are the empty string. A null id is never a copy and
nobody's original, and has no labels. Rows that repeat the smallest id of a text are all originals. An id with several
labels has the larger quality and toxicity; a null label is 0. Very long texts are split into words in one row's
memory. Repeated rows count as often as they occur; other columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oligoloom.llm.tables import stored

LETTERS = "ABCDE"
_COPY_BIT = 1 << LETTERS.index("E")

_STEPS = f"""
WITH RECURSIVE steps(prefix, step, filter, bit, before, applied, mask) AS (
    SELECT '', 0, '', 0, 0, 0, CAST(id AS INT) FROM range({1 << len(LETTERS)})
    UNION ALL
    SELECT concat(prefix, next.letter), step + 1, next.letter, next.bit, applied, applied | next.bit, mask
    FROM steps LATERAL VIEW explode(filter(
        array({", ".join(f"struct('{x}' AS letter, {1 << n} AS bit)" for n, x in enumerate(LETTERS))}),
        x -> applied & x.bit = 0)) unused AS next
)
SELECT prefix, step, filter, mask,
       mask & applied = 0 AS kept,
       mask & before = 0 AND mask & bit <> 0 AS removed,
       mask & before <> 0 AND mask & bit <> 0 AS redundant,
       mask = bit AS alone
FROM steps WHERE step > 0
"""


@dataclass(frozen=True)
class Thresholds:
    """A fails below ``min_words``; B below ``distinct_percent`` different words; C above ``capital_percent``
    capitals among the code points; D with any of ``marks``."""

    min_words: int = 50
    distinct_percent: int = 65
    capital_percent: int = 5
    marks: str = "#$%&*|"


def _content_bits(words: Column, text: Column, at: Thresholds) -> Column:
    count = F.size(words).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", "")).cast("long")
    failing = [
        count < at.min_words,
        F.size(F.array_distinct(words)) * F.lit(100).cast("long") < count * at.distinct_percent,
        capitals * 100 > F.length(text).cast("long") * at.capital_percent,
        text.rlike("[" + "".join("\\" + c for c in at.marks) + "]"),
    ]
    bits = F.lit(0)
    for n, fails in enumerate(failing):
        bits = bits.bitwiseOR(F.when(fails, 1 << n).otherwise(0))
    return bits


def failed_filters(
    docs: DataFrame, at: Thresholds = Thresholds(), doc: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    """(doc_id, part, mask, n): how many rows of an id and a part fail exactly the filters in ``mask``."""
    texts = docs.select(
        F.col(doc).alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    worded = texts.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    slim = worded.select(
        "doc_id",
        "part",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        _content_bits(F.col("words"), F.col("text"), at).alias("bits"),
    )
    counted = slim.groupBy("digest", "doc_id", "part", "bits").agg(F.count(F.lit(1)).alias("n"))
    counted = stored(counted, "failed-filters")
    original = counted.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    flagged = counted.join(original.withColumn("original", F.lit(True)), ["digest", "doc_id"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("original").isNull()
    mask = F.col("bits").bitwiseOR(F.when(copy, _COPY_BIT).otherwise(0))
    return flagged.groupBy("doc_id", "part", mask.alias("mask")).agg(F.sum("n").alias("n"))


def mask_cells(failed: DataFrame, labels: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each cell, and how many are labelled good and toxic."""
    by_id = labels.where(F.col(doc).isNotNull()).groupBy(F.col(doc).alias("doc_id"))
    marks = by_id.agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxicity"))
    rows = failed.join(marks, "doc_id", "left")
    return rows.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("quality") == 1, F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxicity") == 1, F.col("n")).otherwise(0)).alias("toxic"),
    )


def _total(condition: str, count: str) -> Column:
    return F.sum(F.when(F.col(condition), F.col(count)).otherwise(0))


def order_metrics(cells: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, zeros included."""
    steps = stored(cells.sparkSession.sql(_STEPS), "filter-steps")
    metrics = (
        cells.join(F.broadcast(steps), "mask")
        .groupBy("part", "prefix", "step", "filter")
        .agg(
            _total("kept", "n").alias("kept"),
            _total("removed", "n").alias("removed"),
            _total("redundant", "n").alias("redundant"),
            _total("alone", "n").alias("unique_fails"),
            _total("removed", "good").alias("good_lost"),
            _total("removed", "toxic").alias("toxic_lost"),
        )
    )
    # A prefix of k letters begins (5 - k)! orders; 65 prefixes of a part end with a given letter.
    orders_of_prefix = F.factorial(F.lit(len(LETTERS)) - F.col("step"))
    everywhere = metrics.groupBy("part", "filter").agg(F.sum(F.col("removed") * orders_of_prefix).alias("shapley"))
    whole = steps.where((F.col("step") == len(LETTERS)) & (F.col("mask") == 0))
    orders = whole.select(F.col("prefix").alias("filter_order")).withColumn(
        "prefix", F.explode(F.expr(f"transform(sequence(1, {len(LETTERS)}), k -> left(filter_order, k))"))
    )
    return metrics.join(everywhere, ["part", "filter"]).join(F.broadcast(orders), "prefix").select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
        "shapley", "filter",
    )


def audit_filters(
    docs: DataFrame,
    labels: DataFrame,
    at: Thresholds = Thresholds(),
    doc: str = "doc_id",
    text: str = "text",
    part: str = "source",
) -> DataFrame:
    """Metrics of every step of every order for each part; ``labels``: (doc_id, quality, toxic)."""
    cells = stored(mask_cells(failed_filters(docs, at, doc, text, part), labels, doc), "mask-cells")
    return order_metrics(cells)
