"""Sources and sinks. All are Spark's own readers, so splits, locality, pruning and pushdown are Spark's."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any, NamedTuple
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Location(NamedTuple):
    scheme: str
    user: str | None
    host: str | None
    port: int | None
    path: str


def location(uri: str) -> Location:
    """scheme://[user@]host:port/path in parts; a bare path has the scheme "file"."""
    u = urlsplit(uri)
    if u.scheme and "://" not in uri and not uri.startswith(f"{u.scheme}:/"):
        raise ValueError(f"not a location: {uri!r}")
    return Location(u.scheme or "file", u.username, u.hostname, u.port, u.path)


def text_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """A row per line, in column ``value``, of files or folders."""
    return spark.read.text(list(paths))


def json_rows(spark: SparkSession, path: str, schema: T.StructType | str, *, pretty: bool = True) -> DataFrame:
    """Objects of JSON files; ``pretty`` reads one array or object over many lines, else one object a line."""
    return spark.read.schema(schema).json(path, multiLine=pretty)


def csv_rows(spark: SparkSession, path: str, schema: T.StructType | str, *, sep: str = ",", header: bool = False) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep=sep, header=header)


def parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def orc(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.orc(*paths)


def jdbc(spark: SparkSession, url: str, table: str, *, partition_column: str | None = None, lower: Any = None, upper: Any = None, partitions: int = 1, **properties: str) -> DataFrame:
    """A database table, read in ranges of ``partition_column`` in parallel; the driver's jar must be present."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **properties)
    if partition_column:
        reader = reader.options(partitionColumn=partition_column, lowerBound=lower, upperBound=upper, numPartitions=partitions)
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, *, mode: str = "errorifexists", batch: int = 10_000, **properties: str) -> None:
    """Write to a database table, a connection a partition, in batches; the driver's jar must be present."""
    df.write.format("jdbc").mode(mode).options(url=url, dbtable=table, batchsize=batch, **properties).save()


def from_rows(spark: SparkSession, rows: Sequence, schema: T.StructType | str) -> DataFrame:
    """In-memory rows; the schema is stated, so that no rows are fine too."""
    if isinstance(schema, str) and schema.strip().isidentifier() or isinstance(schema, T.DataType) and not isinstance(schema, T.StructType):
        rows, schema = [(r,) for r in rows], f"value {schema if isinstance(schema, str) else schema.simpleString()}"
    return spark.createDataFrame(rows, schema)


def parallelize(spark: SparkSession, rows: Sequence, schema: T.StructType | str, partitions: int | None = None) -> DataFrame:
    """In-memory rows dealt to ``partitions`` in turn (default: the cluster's cores)."""
    return from_rows(spark, rows, schema).repartition(partitions or spark.sparkContext.defaultParallelism)


def horizontal(spark: SparkSession, schema: T.StructType | str, *parts: Sequence) -> DataFrame:
    """The union of several in-memory sequences, each a partition of its own."""
    out = None
    for rows in parts:
        df = from_rows(spark, rows, schema).coalesce(1)
        out = df if out is None else out.unionByName(df)
    return from_rows(spark, [], schema) if out is None else out


def named(spark: SparkSession, name: str) -> DataFrame:
    """A dataset that was published under a name, as a view or table."""
    return spark.table(name)


def publish(df: DataFrame, name: str, *, everywhere: bool = False) -> None:
    """Give a dataset a name: for this session, or for all sessions of the application (``global_temp.name``)."""
    (df.createOrReplaceGlobalTempView if everywhere else df.createOrReplaceTempView)(name)


def write(df: DataFrame, path: str, kind: str = "parquet", *, mode: str = "errorifexists", partition_by: Iterable[str] = (), **options: str) -> None:
    """Write to files; ``kind`` is parquet, orc, json, csv or text."""
    writer = df.write.mode(mode).options(**options)
    if names := list(partition_by):
        writer = writer.partitionBy(*names)
    writer.format(kind).save(path)
