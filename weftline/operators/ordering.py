"""Total order, top k and global row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.names import unused
from weftline.session import cut_lineage


def sort_by(df: DataFrame, *keys: Column | str) -> DataFrame:
    """A total order: sampled ranges, one sort per range. Nulls come first ascending and last descending, unless said otherwise."""
    return df.orderBy(*keys)


def top(df: DataFrame, k: int, *keys: Column | str) -> DataFrame:
    """The first ``k`` rows by ``keys`` (usually descending): each task keeps k rows, no full sort."""
    return df.orderBy(*keys).limit(k)


def top_per_key(df: DataFrame, k: int, key: str, *order: Column) -> DataFrame:
    """The first ``k`` rows of each key; a key's rows are cut to k in each task before they meet."""
    from pyspark.sql import Window

    rank = unused(df, stem="rank")
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col(rank) <= k).drop(rank)


def zip_with_index(df: DataFrame, *keys: Column | str, name: str = "index") -> DataFrame:
    """``df`` with a contiguous index from 0 in the order of ``keys`` (or of partitions and rows).

    Rows are ranged and sorted once and stored; an index is the place in the partition plus the
    sizes of those before, of which there is one number per partition: no task sees all rows.
    """
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    place, part, before = (unused(df, stem=x) for x in ("place", "part", "before"))
    ordered = df.orderBy(*keys) if keys else df
    placed = cut_lineage(ordered.withColumn(place, F.monotonically_increasing_id()))
    number = F.shiftright(F.col(place), 33)
    sizes = {r["p"]: r["n"] for r in placed.groupBy(number.alias("p")).agg(F.count("*").alias("n")).collect()}
    total, offsets = 0, []
    for p in sorted(sizes):
        offsets.append((p, total))
        total += sizes[p]
    if not offsets:
        return df.withColumn(name, F.lit(0).cast("long"))
    table = placed.sparkSession.createDataFrame(offsets, f"{part} long, {before} long")
    inside = F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    joined = placed.withColumn(part, number.cast("long")).join(F.broadcast(table), part)
    return joined.withColumn(name, F.col(before) + inside).drop(place, part, before)
