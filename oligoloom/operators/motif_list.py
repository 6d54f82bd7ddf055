"""Forbidden motifs from a table of any size.

A handful of motifs is a handful of ``contains`` (see ``functions.motifs``). A long list would make the plan grow with it,
so here the words of the candidates, of every length that occurs in the list, are looked up in the table of motifs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oligoloom.functions.sequence import reverse_complement, words_sql


def motif_table(motifs: DataFrame, column: str, include_reverse_complements: bool = True) -> DataFrame:
    """(motif): upper-cased, each once; nulls and empty texts ban nothing."""
    text = F.upper(F.col(column))
    forms = F.array(text, reverse_complement(text)) if include_reverse_complements else F.array(text)
    return motifs.select(F.explode(forms).alias("motif")).where("motif <> ''").distinct()


def with_listed_motif(
    candidates: DataFrame, motifs: DataFrame, length: int, seq: str = "sequence", order: str = "attempt_id"
) -> DataFrame:
    """The candidates that hold a motif of the table, each once; ``length`` is that of the candidates."""
    sizes = [r.n for r in motifs.select(F.length("motif").alias("n")).distinct().collect() if r.n <= length]
    if not sizes:
        return candidates.select(order, seq).limit(0)
    arrays = [F.expr(words_sql(seq, n, range(length - n + 1))) for n in sorted(sizes)]
    words = candidates.select(order, seq, F.explode(F.array_distinct(F.concat(*arrays))).alias("motif"))
    return words.join(motifs, "motif", "left_semi").select(order, seq).distinct()
