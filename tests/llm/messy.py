"""Documents with everything that can be odd about a row."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, ids string, n long, rows long, rank int,"
    " kind string, key string, code string, found string, nodes string, block int, label string, score double"
)


def docs(spark: SparkSession, texts: list[tuple[int | None, str | None]]) -> DataFrame:
    rows = [
        (i, t, None if n % 3 == 0 else "en", "a" if n % 2 else None, None if t is None else len(t))
        + ("x", 1, 2, 3, "y", "z", "c", "f", "o", 4, "l", 0.5)
        for n, (i, t) in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA)


LONG = "the quick brown fox jumps over lazy dogs near 42 rivers and " * 4000

TEXTS = [
    (1, "One short text."),
    (2, None),
    (3, ""),
    (4, LONG),
    (5, "One short text."),
    (5, "One short text."),
    (None, "no id here, but words"),
    (None, None),
    (7, "日本語 and ελληνικά and 'quoted' it's \t\n  "),
    (8, " \n\t "),
]
