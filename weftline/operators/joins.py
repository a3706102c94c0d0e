"""Cogroup and joins. Strategy, skew splitting and broadcasts of small sides are left to adaptive execution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.names import unused
from weftline.operators.keyed import KEY, VALUE, column, keyed


#: Pairs of rows from which a join may be dealt over all cores. Bytes of a side that may be broadcast for that, and, a core, of the one that is dealt.
MANY_PAIRS, BROADCAST, DEALT = 50_000_000, 8 << 20, 16 << 20


def cogroup(left: DataFrame, right: DataFrame, left_key: Column | str, right_key: Column | str, left_value: Column | str | None = None, right_value: Column | str | None = None) -> DataFrame:
    """(key, left_values, right_values): every key of either side; a side without it has an empty array.

    Each side is grouped on its own before the full outer join, so a key meets itself once; the
    arrays hold a key's rows, so use ``cogroup_aggregate`` where a key may hold very many.
    """
    a = keyed(left, left_key, left_value).groupBy(KEY).agg(F.sort_array(F.collect_list(VALUE)).alias("left_values"))
    b = keyed(right, right_key, right_value).groupBy(KEY).agg(F.sort_array(F.collect_list(VALUE)).alias("right_values"))
    return _outer(a, b).select(KEY, *[F.coalesce(c, F.array()).alias(c) for c in ("left_values", "right_values")])


def _outer(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer join on key where null keys are one key too, as in grouping."""
    other = unused(a, b, stem="k")
    b = b.withColumnRenamed(KEY, other)
    return a.join(b, F.col(KEY).eqNullSafe(F.col(other)), "full_outer").withColumn(KEY, F.coalesce(KEY, other)).drop(other)


def cogroup_aggregate(left: DataFrame, right: DataFrame, left_key: Column | str, right_key: Column | str, left_aggregates: dict[str, Column], right_aggregates: dict[str, Column]) -> DataFrame:
    """As ``cogroup``, with aggregates of each side in place of arrays; null for a side without the key."""
    a = left.groupBy(column(left_key).alias(KEY)).agg(*[c.alias(n) for n, c in left_aggregates.items()])
    b = right.groupBy(column(right_key).alias(KEY)).agg(*[c.alias(n) for n, c in right_aggregates.items()])
    return _outer(a, b)


def join_by(left: DataFrame, right: DataFrame, left_key: Column | str, right_key: Column | str, how: str = "inner") -> DataFrame:
    """Rows of both sides with equal keys, with a column ``key``; null keys match nothing.

    ``how`` may be any of Spark's join types. Columns of the right side whose names the left
    has too get the prefix ``right_``.
    """
    lk, rk = unused(left, right, stem="lk"), unused(left, right, stem="rk")
    a = left.withColumn(lk, column(left_key))
    b = right.withColumn(rk, column(right_key))
    clash = set(left.columns) & set(right.columns)
    b = b.select(*[F.col(f"`{c}`").alias(f"right_{c}" if c in clash else c) for c in b.columns])
    out = a.join(b, F.col(lk) == F.col(rk), how)
    if how.replace("_", "") in ("leftsemi", "semi", "leftanti", "anti"):
        return out.withColumnRenamed(lk, KEY)
    return out.withColumn(KEY, F.coalesce(lk, rk)).drop(lk, rk)


def _planned_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _spread(a: DataFrame, b: DataFrame, how: str) -> tuple[DataFrame, DataFrame]:
    """The sides of a join of which few keys may make very many rows out of few bytes.

    Tasks are made by bytes read and by keys, so one or a few would make all rows. The smaller
    side is broadcast and the other's rows are dealt over all cores, so each makes its share.
    Sides too large for that have tasks enough.
    """
    x, y = _planned_bytes(a), _planned_bytes(b)
    swap = how == "inner" and x < y
    small, large = min(x, y) if swap else y, max(x, y) if swap else x
    spark = a.sparkSession
    cores = spark.sparkContext.defaultParallelism
    # four bytes a row, about, in compressed files
    if how not in ("inner", "left_outer") or x * y // 16 < MANY_PAIRS or small > BROADCAST or large > DEALT * cores:
        return a, b
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * cores)
    return (F.broadcast(a), b.repartition(parts)) if swap else (a.repartition(parts), F.broadcast(b))


def join_by_key(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """(key, left_value, right_value) of two keyed datasets."""
    a = left.select(KEY, F.col(VALUE).alias("left_value"))
    b = right.select(KEY, F.col(VALUE).alias("right_value"))
    a, b = _spread(a, b, how)
    return a.join(b, KEY, how)


def join_by_key_opt(left: DataFrame, right: DataFrame) -> DataFrame:
    """As ``join_by_key``, keeping left rows without a partner, whose right_value is null."""
    return join_by_key(left, right, "left_outer")


def join_many(*sides: DataFrame) -> DataFrame:
    """(key, value_1, ..., value_n) for keys that all keyed datasets have."""
    out = sides[0].select(KEY, F.col(VALUE).alias("value_1"))
    for i, side in enumerate(sides[1:], 2):
        out = out.join(side.select(KEY, F.col(VALUE).alias(f"value_{i}")), KEY)
    return out
