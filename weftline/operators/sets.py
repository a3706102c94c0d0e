"""Set operations by column name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union(*sides: DataFrame) -> DataFrame:
    """All rows of all sides, repeats included; no data moves."""
    return reduce(DataFrame.unionByName, sides)


def distinct(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropDuplicates(list(columns)) if columns else df.distinct()


def intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of both sides; nulls equal each other."""
    return left.intersect(right.select(left.columns))


def subtract(left: DataFrame, right: DataFrame, *, repeats: bool = False) -> DataFrame:
    """Rows of ``left`` that ``right`` lacks: distinct, or as often as they are left over if ``repeats``."""
    right = right.select(left.columns)
    return left.exceptAll(right) if repeats else left.subtract(right)
