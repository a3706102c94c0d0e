"""Actions: now or in the background, with a time limit, as values, references or a stream of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from weftline.functions.reducers import Reducer, reducer
from weftline.session import cut_lineage

_POOL = ThreadPoolExecutor(max_workers=16, thread_name_prefix="weftline")


def in_background(spark, f: Callable[[], Any], *, group: str = "weftline") -> Future:
    """``f`` in a thread of its own, whose Spark jobs belong to ``group`` and end if the future is cancelled in time."""
    done: Future = Future()

    def run():
        if done.set_running_or_notify_cancel():
            spark.sparkContext.setJobGroup(group, group, interruptOnCancel=True)
            try:
                done.set_result(f())
            except BaseException as e:
                done.set_exception(e)

    _POOL.submit(lambda: (t := InheritableThread(target=run), t.start(), t.join()))
    return done


def compute(df: DataFrame, group: str = "weftline") -> Future:
    """A future of ``df`` computed and kept on the cluster; the driver gets a reference, not rows."""

    def work():
        kept = df.persist()
        kept.count()
        return kept

    return in_background(df.sparkSession, work, group=group)


def traverse(df: DataFrame, group: str = "weftline") -> Future:
    """A future of an iterator that fetches one partition after another."""
    return in_background(df.sparkSession, lambda: df.toLocalIterator(prefetchPartitions=True), group=group)


def collect(df: DataFrame, seconds: float = 500.0) -> list[Row]:
    """All rows, or TimeoutError, with the job cancelled, after ``seconds``."""
    group = f"weftline-collect-{id(df)}"
    future = in_background(df.sparkSession, df.collect, group=group)
    try:
        return future.result(timeout=seconds)
    except Late:
        df.sparkSession.sparkContext.cancelJobGroup(group)
        raise


def cached(df: DataFrame) -> DataFrame:
    """``df`` computed now and kept in memory, or on disk where that is short."""
    kept = df.persist()
    kept.count()
    return kept


def count(df: DataFrame) -> DataFrame:
    """One row with ``count``, 0 for no rows."""
    return df.agg(F.count("*").alias("count"))


def reduce(df: DataFrame, column: str, how: Reducer) -> DataFrame:
    """One row with ``value``; no row where there is nothing to reduce."""
    return df.agg(reducer(how)(F.col(column)).alias("value"), F.count(column).alias("_n")).filter("_n > 0").select("value")


def fold(df: DataFrame, column: str, zero, how: Reducer) -> DataFrame:
    """One row with ``value``, ``zero`` where there is nothing to reduce."""
    return df.agg(F.coalesce(reducer(how)(F.col(column)), F.lit(zero)).alias("value"))


def fold_ordered(df: DataFrame, key: str, column: str, order: str, zero, step: Callable, *, from_right: bool = False) -> DataFrame:
    """(key, value): a fold of each key's values in the order of ``order``, for steps that are not associative.

    The values of a key meet in one array.
    """
    start = F.lit(zero).cast(df.schema[column].dataType)
    values = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(column).alias("x"))), asc=not from_right), lambda s: s["x"])
    return df.groupBy(key).agg(F.aggregate(values, start, step).alias("value"))


def foreach(df: DataFrame, f: Callable[[Iterator[Row]], None]) -> None:
    """``f`` with the rows of each partition, on the executors."""
    df.foreachPartition(f)


def repeat(df: DataFrame, n: int, step: Callable[[DataFrame], DataFrame], *, cut_every: int = 5) -> DataFrame:
    """``step`` applied ``n`` times; lineage is cut after every ``cut_every`` steps."""
    for i in range(1, n + 1):
        df = step(df)
        if i % cut_every == 0:
            df = cut_lineage(df)
    return df


def repeat_while(df: DataFrame, goes_on: Callable[[DataFrame, DataFrame], bool], step: Callable[[DataFrame], DataFrame], *, most: int = 100) -> DataFrame:
    """``step`` applied until ``goes_on(before, after)`` is false, ``most`` times at most; each state is stored."""
    for _ in range(most):
        after = cut_lineage(step(df))
        if not goes_on(df, after):
            return after
        df = after
    return df
