"""Columns that are computed once.

The optimizer pushes filters below projections by substituting the projected expressions. For
expressions that are built in several steps, each using the previous one many times, that
repeats the work and can blow up the generated code. A generator that emits exactly one row
keeps such columns in place, and one that emits none doubles as the filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stage(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns which later filters use but do not re-compute."""
    record = F.struct(*[column.alias(name) for name, column in columns.items()])
    return rows.select("*", F.inline(F.array(record)))


def keep(rows: DataFrame, condition: Column, columns: dict[str, Column]) -> DataFrame:
    """The given columns of the rows that meet the condition."""
    record = F.struct(*[column.alias(name) for name, column in columns.items()])
    return rows.select(F.inline(F.when(condition, F.array(record))))
