"""Operators on rows with ``key`` and ``value`` and on groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.reducers import Reducer, reduce_python, reducer

KEY, VALUE, VALUES = "key", "value", "values"
Expr = Column | str | Callable[[Column], Column]


def column(expr: Column | str) -> Column:
    """A column from itself, a column's name or a SQL expression."""
    return expr if isinstance(expr, Column) else F.expr(expr)


def applied(expr: Expr, to: str) -> Column:
    """``expr`` of column ``to``: a function of the column, or any column expression."""
    return expr(F.col(to)) if callable(expr) and not isinstance(expr, Column) else column(expr)


def keyed(df: DataFrame, key: Column | str, value: Column | str | None = None) -> DataFrame:
    """(key, value); without ``value`` it is the whole row as a struct."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]) if value is None else column(value)
    return df.select(column(key).alias(KEY), whole.alias(VALUE))


def map_values(df: DataFrame, f: Expr) -> DataFrame:
    return df.withColumn(VALUE, applied(f, VALUE))


def map_key(df: DataFrame, f: Expr) -> DataFrame:
    return df.withColumn(KEY, applied(f, KEY))


def swap(df: DataFrame) -> DataFrame:
    return df.select(F.col(VALUE).alias(KEY), F.col(KEY).alias(VALUE))


def find_by_key(df: DataFrame, f: Expr) -> DataFrame:
    """Rows whose key satisfies ``f``. Over groups Catalyst moves it below the shuffle, to the scan."""
    return df.filter(applied(f, KEY))


def find_by_value(df: DataFrame, f: Expr) -> DataFrame:
    return df.filter(applied(f, VALUE))


def reduce_by_key(df: DataFrame, how: Reducer | Callable, *, python: bool = False) -> DataFrame:
    """(key, value): one row per key; null keys are one group. ``python`` takes ``how`` as a Python function of two values."""
    if python:
        return reduce_python(df, KEY, VALUE, how)
    return df.groupBy(KEY).agg(reducer(how)(F.col(VALUE)).alias(VALUE))


def fold_by_key(df: DataFrame, zero, how: Reducer) -> DataFrame:
    """Like ``reduce_by_key``, with ``zero`` where all values of a key are null."""
    return df.groupBy(KEY).agg(F.coalesce(reducer(how)(F.col(VALUE)), F.lit(zero)).alias(VALUE))


def group_reduce(df: DataFrame, key: Column | str, **aggregates: Column) -> DataFrame:
    """One row per key with the named aggregates: partial per task, then final."""
    return df.groupBy(column(key).alias(KEY)).agg(*[c.alias(name) for name, c in aggregates.items()])


def group_map_reduce(df: DataFrame, key: Column | str, value: Column | str, how: Reducer) -> DataFrame:
    return reduce_by_key(keyed(df, key, value), how)


class Groups:
    """Rows grouped by key, not materialised: reductions run as partial aggregates.

    Only ``collect`` and what returns arrays gathers a key's rows in one place. Use those where
    groups are known to be of moderate size; everything else copes with any key.
    """

    def __init__(self, df: DataFrame):
        self.df = df

    def reduce(self, how: Reducer) -> DataFrame:
        return reduce_by_key(self.df, how)

    def sizes(self) -> DataFrame:
        return self.df.groupBy(KEY).agg(F.count("*").alias("size"))

    def map_values(self, f: Expr) -> Groups:
        """``f`` of each value in each group."""
        return Groups(map_values(self.df, f))

    def find_by_key(self, f: Expr) -> Groups:
        return Groups(find_by_key(self.df, f))

    def find_values(self, f: Expr) -> DataFrame:
        """(key, values): the values of each group that satisfy ``f``; groups left empty stay, with an empty array."""
        return self.df.groupBy(KEY).agg(F.sort_array(F.collect_list(F.when(applied(f, VALUE), F.col(VALUE)))).alias(VALUES))

    def reduce_values(self, how: Reducer, f: Expr | None = None) -> DataFrame:
        """(key, value): ``how`` over the values of each group, or over ``f`` of them."""
        df = self.df if f is None else map_values(self.df, f)
        return reduce_by_key(df, how)

    def collect(self) -> DataFrame:
        """(key, values), values sorted."""
        return self.df.groupBy(KEY).agg(F.sort_array(F.collect_list(VALUE)).alias(VALUES))


def group_by(df: DataFrame, key: Column | str, value: Column | str | None = None) -> Groups:
    return Groups(keyed(df, key, value))
