"""Names for columns that an operator adds and takes away again."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(*frames: DataFrame, stem: str) -> str:
    """A column name that none of the frames has, in any case of letters."""
    taken, name = {c.lower() for df in frames for c in df.columns}, f"_{stem}"
    while name in taken:
        name += "_"
    return name
