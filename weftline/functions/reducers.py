"""Associative reducers: names and column builders that run as partial aggregates, Python functions as a fallback."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Reducer = str | Callable[[Column], Column]

NAMED: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "avg": F.avg,
    "first": F.first,
    "product": F.product,
    "any": F.bool_or,
    "all": F.bool_and,
    "concat": lambda c: F.concat_ws("", F.sort_array(F.collect_list(c))),
}


def reducer(how: Reducer) -> Callable[[Column], Column]:
    if callable(how):
        return how
    if how not in NAMED:
        raise ValueError(f"no reducer {how!r}; there are {sorted(NAMED)}")
    return NAMED[how]


def exact_sum(value: Column, scale: int = 2) -> Column:
    """The sum of decimals kept as doubles, the same in any order of rows.

    Whole units of the last place are added as longs; beyond 9.2e18 of them the sum is an error.
    """
    return F.sum(F.round(value * 10**scale).cast("long")) / F.lit(float(10**scale))


def reduce_rows_python(df: DataFrame, f: Callable[[dict, dict], dict], *keys: str) -> DataFrame:
    """Rows of equal ``keys`` (of all rows, without keys) combined in pairs by ``f(row, row) -> row``; no row without rows.

    Rows are dicts of all columns. ``f`` must be associative and commutative and keep the keys.
    Batches are combined before rows move, and once more where they meet: a task hands on one row
    a key and batch at most.
    """
    columns, schema = df.columns, df.schema
    key_of = lambda r: tuple(r[k] for k in keys)

    def combined(frames):
        for pdf in frames:
            held: dict = {}
            for r in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
                k = key_of(r)
                held[k] = f(held[k], r) if k in held else r
            yield pd.DataFrame(list(held.values()), columns=columns, dtype=object)

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        return next(combined([pdf]))

    local = df.mapInPandas(combined, schema)
    if keys:
        return local.groupBy(*keys).applyInPandas(final, schema)

    def last(frames):
        out = None
        for pdf in combined(frames):
            for r in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
                out = r if out is None else f(out, r)
        if out is not None:
            yield pd.DataFrame([out], columns=columns, dtype=object)

    return local.mapInPandas(last, schema).coalesce(1).mapInPandas(last, schema)


def reduce_python(df: DataFrame, key: str, value: str, f: Callable, *, most_held: int = 100_000) -> DataFrame:
    """(key, value): values of each key combined by the associative and commutative Python function ``f``.

    Each partition combines its own rows in batches first, so a hot key sends few rows per
    partition into the final step; beyond ``most_held`` keys what is combined is passed on.
    """
    schema = df.select(key, value).schema

    def partial(batches):
        held: dict = {}
        for pdf in batches:
            for k, v in zip(pdf[key], pdf[value], strict=True):
                k = None if pd.isna(k) else k
                held[k] = f(held[k], v) if k in held else v
            if len(held) > most_held:
                yield pd.DataFrame({key: list(held), value: list(held.values())}, columns=[key, value])
                held = {}
        if held:
            yield pd.DataFrame({key: list(held), value: list(held.values())}, columns=[key, value])

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        values = iter(pdf[value])
        out = next(values)
        for v in values:
            out = f(out, v)
        return pd.DataFrame({key: [pdf[key].iloc[0]], value: [out]})

    return df.select(key, value).mapInPandas(partial, schema).groupBy(key).applyInPandas(final, schema)
