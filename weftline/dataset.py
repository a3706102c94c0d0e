"""``Dataset``: an immutable, lazily chained wrapper over a DataFrame.

Operators take columns, column names or SQL expressions, which Catalyst sees through; a Python
function needs a schema for its result and runs on Arrow batches. Keyed operators use columns
``key`` and ``value``.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from weftline.functions.reducers import reduce_rows_python
from weftline.operators import actions, joins, keyed, ordering, partitioning, sampling, sets
from weftline.plans import provenance
from weftline.sources import readers


@dataclass(frozen=True)
class Dataset:
    df: DataFrame

    # constructors

    @classmethod
    def text(cls, spark: SparkSession, *paths: str) -> Dataset:
        return cls(readers.text_lines(spark, *paths))

    @classmethod
    def parquet(cls, spark: SparkSession, *paths: str) -> Dataset:
        return cls(readers.parquet(spark, *paths))

    @classmethod
    def json(cls, spark: SparkSession, path: str, schema, *, pretty: bool = True) -> Dataset:
        return cls(readers.json_rows(spark, path, schema, pretty=pretty))

    @classmethod
    def parallelize(cls, spark: SparkSession, rows, schema, partitions: int | None = None) -> Dataset:
        return cls(readers.parallelize(spark, rows, schema, partitions))

    @classmethod
    def horizontal(cls, spark: SparkSession, schema, *parts) -> Dataset:
        return cls(readers.horizontal(spark, schema, *parts))

    @classmethod
    def named(cls, spark: SparkSession, name: str) -> Dataset:
        return cls(readers.named(spark, name))

    # rows

    def map(self, *columns: Column | str | Callable, schema: Any = None, **named: Column | str) -> Dataset:
        """New rows of the given columns. A Python function of a pandas frame, with ``schema``, maps batches."""
        if len(columns) == 1 and callable(columns[0]) and not isinstance(columns[0], Column):
            if schema is None:
                raise ValueError("a Python function needs the schema of its result")
            f = columns[0]
            return Dataset(self.df.mapInPandas(lambda frames: map(f, frames), schema))
        return Dataset(self.df.select(*[keyed.column(c) for c in columns], *[keyed.column(c).alias(n) for n, c in named.items()]))

    __call__ = map

    def filter(self, condition: Column | str) -> Dataset:
        return Dataset(self.df.filter(condition))

    def flat_map(self, array: Column | str, name: str = "value") -> Dataset:
        """A row per element of an array expression."""
        return Dataset(self.df.select(F.explode(keyed.column(array)).alias(name)))

    def map_partitions(self, f: Callable, schema) -> Dataset:
        """``f`` maps an iterator of pandas frames to one, partition by partition."""
        return Dataset(self.df.mapInPandas(f, schema))

    def map_partitions_with_index(self, f: Callable, schema) -> Dataset:
        """``f(index, frames)``, with the partition's number."""

        def numbered(frames):
            from pyspark import TaskContext

            return f(TaskContext.get().partitionId(), frames)

        return Dataset(self.df.mapInPandas(numbered, schema))

    def flatten(self, arrays: Column | str, name: str = "value") -> Dataset:
        """A row per element of the arrays in an array of arrays."""
        return Dataset(self.df.select(F.explode(F.flatten(keyed.column(arrays))).alias(name)))

    def zip_with_index(self, *keys, name: str = "index") -> Dataset:
        return Dataset(ordering.zip_with_index(self.df, *keys, name=name))

    # keys

    def keyed(self, key: Column | str, value: Column | str | None = None) -> Dataset:
        return Dataset(keyed.keyed(self.df, key, value))

    def map_values(self, f) -> Dataset:
        return Dataset(keyed.map_values(self.df, f))

    def map_key(self, f) -> Dataset:
        return Dataset(keyed.map_key(self.df, f))

    def swap(self) -> Dataset:
        return Dataset(keyed.swap(self.df))

    def find_by_key(self, f) -> Dataset:
        return Dataset(keyed.find_by_key(self.df, f))

    def find_by_value(self, f) -> Dataset:
        return Dataset(keyed.find_by_value(self.df, f))

    def reduce_by_key(self, how, *, python: bool = False) -> Dataset:
        return Dataset(keyed.reduce_by_key(self.df, how, python=python))

    def fold_by_key(self, zero, how) -> Dataset:
        return Dataset(keyed.fold_by_key(self.df, zero, how))

    def group_by(self, key: Column | str, value: Column | str | None = None) -> keyed.Groups:
        return keyed.group_by(self.df, key, value)

    def group_reduce(self, key: Column | str, **aggregates: Column) -> Dataset:
        return Dataset(keyed.group_reduce(self.df, key, **aggregates))

    def group_map_reduce(self, key: Column | str, value: Column | str, how) -> Dataset:
        return Dataset(keyed.group_map_reduce(self.df, key, value, how))

    # two datasets

    def cogroup(self, other: Dataset, key, other_key, value=None, other_value=None) -> Dataset:
        return Dataset(joins.cogroup(self.df, other.df, key, other_key, value, other_value))

    def cogroup_by_key(self, other: Dataset) -> Dataset:
        return self.cogroup(other, keyed.KEY, keyed.KEY, keyed.VALUE, keyed.VALUE)

    def join_by(self, other: Dataset, key, other_key, how: str = "inner") -> Dataset:
        return Dataset(joins.join_by(self.df, other.df, key, other_key, how))

    def join_by_key(self, other: Dataset, how: str = "inner") -> Dataset:
        return Dataset(joins.join_by_key(self.df, other.df, how))

    def join_by_key_opt(self, other: Dataset) -> Dataset:
        return Dataset(joins.join_by_key_opt(self.df, other.df))

    def union(self, *others: Dataset) -> Dataset:
        return Dataset(sets.union(self.df, *[o.df for o in others]))

    def distinct(self, *columns: str) -> Dataset:
        return Dataset(sets.distinct(self.df, *columns))

    def intersection(self, other: Dataset) -> Dataset:
        return Dataset(sets.intersection(self.df, other.df))

    def subtract(self, other: Dataset, *, repeats: bool = False) -> Dataset:
        return Dataset(sets.subtract(self.df, other.df, repeats=repeats))

    # order and place

    def sort_by(self, *keys) -> Dataset:
        return Dataset(ordering.sort_by(self.df, *keys))

    def top(self, k: int, *keys) -> Dataset:
        return Dataset(ordering.top(self.df, k, *keys))

    def limit(self, n: int) -> Dataset:
        return Dataset(self.df.limit(n))

    def partition_by(self, n: int, *keys) -> Dataset:
        return Dataset(partitioning.by_hash(self.df, n, *keys))

    def partition_by_range(self, n: int, *keys, sort: bool = False) -> Dataset:
        return Dataset(partitioning.by_range(self.df, n, *keys, sort=sort))

    def partition_by_number(self, n: int, number: Column) -> Dataset:
        return Dataset(partitioning.by_number(self.df, n, number))

    def partition(self, partitioner: partitioning.Partitioner) -> Dataset:
        return Dataset(partitioning.partition(self.df, partitioner))

    with_partitioner = partition

    def fewer(self, n: int) -> Dataset:
        """At most ``n`` partitions, without a shuffle."""
        return Dataset(partitioning.fewer(self.df, n))

    def partition_in_turn(self, n: int) -> Dataset:
        return Dataset(partitioning.in_turn(self.df, n))

    def with_parallelism(self, n: int) -> Dataset:
        """``n`` partitions, without a shuffle where there are more now."""
        return Dataset(partitioning.with_partitions(self.df, n))

    def compress(self, codec: str = "zstd") -> Dataset:
        """Cached columns and written files of this session are compressed, by ``codec``, from now on; shuffled blocks always are."""
        conf = self.df.sparkSession.conf
        conf.set("spark.sql.inMemoryColumnarStorage.compressed", "true")
        conf.set("spark.sql.parquet.compression.codec", codec)
        conf.set("spark.sql.orc.compression.codec", codec)
        return self

    # samples and actions

    def sample_n(self, n: int) -> Dataset:
        return Dataset(sampling.first_rows(self.df, n))

    def sample(self, share: float, seed: int | None = None) -> Dataset:
        return Dataset(sampling.fraction(self.df, share, seed))

    def sample_with(self, f: Callable, schema=None) -> Dataset:
        return Dataset(sampling.by_function(self.df, f, schema))

    def count(self) -> Dataset:
        return Dataset(actions.count(self.df))

    def count_value(self) -> int:
        return self.df.count()

    def reduce(self, column: str, how) -> Dataset:
        return Dataset(actions.reduce(self.df, column, how))

    def reduce_python(self, f: Callable[[dict, dict], dict]) -> Dataset:
        """All rows combined in pairs by a Python function of two rows, which must be associative and commutative."""
        return Dataset(reduce_rows_python(self.df, f))

    def group_reduce_python(self, f: Callable[[dict, dict], dict], *keys: str) -> Dataset:
        """As ``reduce_python``, for the rows of each key."""
        return Dataset(reduce_rows_python(self.df, f, *keys))

    def fold(self, column: str, zero, how) -> Dataset:
        return Dataset(actions.fold(self.df, column, zero, how))

    def foreach(self, f: Callable) -> None:
        actions.foreach(self.df, f)

    def compute(self) -> Future:
        return actions.compute(self.df)

    def traverse(self) -> Future:
        return actions.traverse(self.df)

    def collect(self, seconds: float = 500.0) -> list[Row]:
        return actions.collect(self.df, seconds)

    def cache(self) -> Dataset:
        """Kept once it is computed."""
        return Dataset(self.df.cache())

    def cached(self) -> Dataset:
        """Computed now and kept."""
        return Dataset(actions.cached(self.df))

    def repeat(self, n: int, step: Callable[[Dataset], Dataset]) -> Dataset:
        return Dataset(actions.repeat(self.df, n, lambda df: step(Dataset(df)).df))

    def repeat_while(self, goes_on: Callable[[Dataset, Dataset], bool], step: Callable[[Dataset], Dataset], *, most: int = 100) -> Dataset:
        return Dataset(actions.repeat_while(self.df, lambda a, b: goes_on(Dataset(a), Dataset(b)), lambda df: step(Dataset(df)).df, most=most))

    def explain(self) -> Dataset:
        return Dataset(provenance.plan_rows(self.df))

    def write(self, path: str, kind: str = "parquet", **options) -> None:
        readers.write(self.df, path, kind, **options)
