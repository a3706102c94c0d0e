"""Placing rows. Joins and aggregates place rows themselves; these are for files, order and Python code per partition."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_hash(df: DataFrame, n: int, *keys: Column | str) -> DataFrame:
    return df.repartition(n, *keys)


def by_range(df: DataFrame, n: int, *keys: Column | str, sort: bool = False) -> DataFrame:
    """Ranges of the keys in order of partitions, found by sampling; optionally sorted within."""
    out = df.repartitionByRange(n, *keys)
    return out.sortWithinPartitions(*keys) if sort else out


def by_number(df: DataFrame, n: int, number: Column) -> DataFrame:
    """Rows in the partition of their ``number`` modulo ``n``; null counts as 0."""
    return df.repartitionById(n, F.coalesce(F.pmod(number.cast("long"), F.lit(n)), F.lit(0)).cast("int"))


@dataclass(frozen=True)
class Partitioner:
    """A way to place rows, as a value: ``place(df, n)``."""

    n: int
    place: Callable[[DataFrame, int], DataFrame]

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.place(df, self.n)


def hash_partitioner(n: int, *keys: Column | str) -> Partitioner:
    return Partitioner(n, lambda df, n: by_hash(df, n, *keys))


def range_partitioner(n: int, *keys: Column | str, sort: bool = False) -> Partitioner:
    return Partitioner(n, lambda df, n: by_range(df, n, *keys, sort=sort))


def number_partitioner(n: int, number: Column) -> Partitioner:
    return Partitioner(n, lambda df, n: by_number(df, n, number))


#: Leaves rows where they are.
KEEP = Partitioner(0, lambda df, n: df)


def partition(df: DataFrame, partitioner: Partitioner) -> DataFrame:
    return partitioner(df)


def with_partitions(df: DataFrame, n: int) -> DataFrame:
    """``n`` partitions: merged without a shuffle where there are more, dealt out where there are fewer."""
    return df.coalesce(n) if df.rdd.getNumPartitions() >= n else df.repartition(n)


def in_turn(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n)


def at_random(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    return df.repartition(n, F.rand(seed))


def by_prefix(df: DataFrame, n: int, key: str, length: int = 7) -> DataFrame:
    """Ranges of the first ``length`` characters or bytes of a key, sorted by the whole key within."""
    return df.repartitionByRange(n, F.substring(key, 1, length)).sortWithinPartitions(key)


def fewer(df: DataFrame, n: int) -> DataFrame:
    """At most ``n`` partitions, without a shuffle."""
    return df.coalesce(n)


def partition_sizes(df: DataFrame) -> DataFrame:
    """(partition, size)."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("size"))
