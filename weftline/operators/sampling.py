"""Samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """``n`` rows, the first to be had: cheap, not random."""
    return df.limit(n)


def fraction(df: DataFrame, share: float, seed: int | None = None, *, replace: bool = False) -> DataFrame:
    """Each row with probability ``share``."""
    return df.sample(withReplacement=replace, fraction=share, seed=seed)


def stratified(df: DataFrame, column: str, shares: dict, seed: int | None = None) -> DataFrame:
    return df.sampleBy(column, shares, seed)


def by_function(df: DataFrame, f: Callable, schema=None) -> DataFrame:
    """A sampler of one's own: ``f`` maps the pandas frames of a partition to those kept."""
    return df.mapInPandas(f, schema or df.schema)
