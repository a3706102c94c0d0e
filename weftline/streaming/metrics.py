"""Monitoring series (prop, key, value, time in ms): bounded history, listings, sums over a horizon, arithmetic."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.names import unused

POINT_DDL = "monitor string, prop string, key string, value string, source string, time long"
DAY_MS = 24 * 3600 * 1000
#: Names and signs of the arithmetic between two sums.
OPERATIONS = {"+": "plus", "-": "minus", "*": "multiply", "/": "divide"}


def retained(points: DataFrame, limit: int = 512, *tie: str) -> DataFrame:
    """The latest ``limit`` points of each prop and key; ``tie`` orders points of the same time."""
    rank, order = unused(points, stem="rank"), Window.partitionBy("prop", "key").orderBy(F.desc("time"), *[F.desc(t) for t in tie])
    return points.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= limit).drop(rank)


def props(points: DataFrame, like: str = "") -> DataFrame:
    return points.filter(F.col("prop").contains(like)).select("prop").distinct()


def keys(points: DataFrame, prop: str, like: str = "") -> DataFrame:
    return points.filter((F.col("prop") == prop) & F.col("key").contains(like)).select("key").distinct()


def data(points: DataFrame, prop: str, key: str) -> DataFrame:
    """(time, value as a number) in order of time."""
    return points.filter((F.col("prop") == prop) & (F.col("key") == key)).select("time", F.col("value").try_cast("float").alias("value")).orderBy("time")


def data_like(points: DataFrame, prop: str, key: str) -> DataFrame:
    """The series of the first prop, by name, that contains ``prop``, and its first key that contains ``key``."""
    hit = points.filter(F.col("prop").contains(prop) & F.col("key").contains(key))
    first = hit.agg(F.min(F.struct("prop", "key")).alias("f")).select("f.prop", "f.key")
    return hit.join(F.broadcast(first), ["prop", "key"]).select("prop", "key", "time", F.col("value").try_cast("float").alias("value")).orderBy("time")


def _within(now: Column | int, duration_ms: int) -> Column:
    """Later than ``now - duration``; no positive duration means the last day."""
    now = F.lit(now) if isinstance(now, int) else now
    return F.col("time") > now - F.lit(duration_ms if duration_ms > 0 else DAY_MS)


def total(points: DataFrame, prop: str, key: str, *, now: Column | int | None = None, duration_ms: int | None = None) -> DataFrame:
    """One row with ``value``: the sum of a series, over all time unless ``now`` and ``duration_ms`` are given; 0 without points."""
    hit = points.filter((F.col("prop") == prop) & (F.col("key") == key))
    if now is not None and duration_ms is not None:
        hit = hit.filter(_within(now, duration_ms))
    return hit.agg(F.coalesce(F.sum(F.col("value").try_cast("double")), F.lit(0.0)).alias("value"))


def totals(points: DataFrame, *, now: Column | int, duration_ms: int) -> DataFrame:
    """(prop, key, value): the sums of all series over a horizon."""
    return points.filter(_within(now, duration_ms)).groupBy("prop", "key").agg(F.sum(F.col("value").try_cast("decimal(18,2)")).cast("double").alias("value"))


def combined(left: Column, operation: str, right: Column) -> Column:
    """left (+ - * /) right, by sign or name; an unknown operation gives left, a division by 0 null."""
    name = OPERATIONS.get(operation, operation)
    if name == "plus":
        return left + right
    if name == "minus":
        return left - right
    if name == "multiply":
        return left * right
    if name == "divide":
        return F.try_divide(left, right)
    return left


def computed(points: DataFrame, left: tuple[str, str], operation: str, right: tuple[str, str], *, now: Column | int, duration_ms: int = 600_000) -> DataFrame:
    """One row with ``value``: two series' sums combined in one pass; a duration of 0 or less is unbounded."""
    if duration_ms > 0:
        points = points.filter(_within(now, duration_ms))
    of = lambda s: F.coalesce(F.sum(F.when((F.col("prop") == s[0]) & (F.col("key") == s[1]), F.col("value").try_cast("double"))), F.lit(0.0))
    return points.agg(of(left).alias("l"), of(right).alias("r")).select(combined(F.col("l"), operation, F.col("r")).alias("value"))


class Counters:
    """Counters of the driver by prop and key, for any thread; a missing key reads as -1, a missing prop as -2.

    What tasks count reaches them through ``add_all``.
    """

    def __init__(self):
        self._values: dict[str, dict[str, int]] = {}
        self._lock = threading.RLock()

    def increase(self, prop: str, key: str, by: int = 1) -> int:
        with self._lock:
            series = self._values.setdefault(prop, {})
            series[key] = series.get(key, 0) + by
            return series[key]

    def add_all(self, counts: DataFrame) -> None:
        """Add what a dataset (prop, key, n) has counted; it is as small as there are counters."""
        for r in counts.groupBy("prop", "key").agg(F.sum("n").alias("n")).collect():
            self.increase(r["prop"], r["key"], r["n"])

    def decrease(self, prop: str, key: str, by: int = 1) -> int:
        return self.increase(prop, key, -by)

    def set(self, prop: str, key: str, value: int) -> None:
        with self._lock:
            self._values.setdefault(prop, {})[key] = value

    def get(self, prop: str, key: str) -> int:
        with self._lock:
            return self._values[prop].get(key, -1) if prop in self._values else -2

    def get_and_reset(self, prop: str, key: str) -> int:
        with self._lock:
            value = self.get(prop, key)
            if value >= 0:
                self._values[prop][key] = 0
            return value


#: Operation codes of series queries.
CODES: dict[str, Callable[..., DataFrame]] = {}


def query(points: DataFrame, code: str, **arguments) -> DataFrame | None:
    """A series query by its code: props, keys, data, data_like, sum, sum_horizon, sum_all or compute; None if there is no such or it fails."""
    try:
        return CODES[code](points, **arguments)
    except Exception:
        return None


def streamed_totals(points: DataFrame, *, window: str = "10 minutes", slide: str | None = None, late: str = "1 minute") -> DataFrame:
    """Sums by prop, key and window over a stream (an extension): ``late`` bounds the state kept."""
    at = F.timestamp_millis(F.col("time"))
    rows = points.withColumn("at", at).withWatermark("at", late)
    return rows.groupBy(F.window("at", window, slide or window), "prop", "key").agg(F.sum(F.col("value").try_cast("double")).alias("value"))


CODES |= {"props": props, "keys": keys, "data": data, "data_like": data_like, "sum": total, "sum_horizon": total, "sum_all": totals, "compute": computed}
