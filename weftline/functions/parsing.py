"""Expressions for raw text lines, with the edge cases of the usual functional idioms pinned down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_fields(line: Column, pattern: str = ",") -> Column:
    """Fields of a line by a regular expression, without trailing empty ones; a line of none but empty ones has one empty field."""
    parts = F.split(line, pattern)
    last = F.aggregate(F.sequence(F.lit(1), F.size(parts)), F.lit(0), lambda a, i: F.when(F.get(parts, i - 1) != "", i).otherwise(a))
    return F.when(line.isNull(), F.lit(None)).when(last == 0, F.array(F.lit(""))).otherwise(F.slice(parts, 1, F.greatest(last, F.lit(1))))


def words(text: Column) -> Column:
    """The non-empty words of a text, cut at white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def full_match(value: Column, pattern: str) -> Column:
    """Whether the whole value matches, unlike ``rlike``, which finds a match anywhere."""
    return value.rlike(f"^(?:{pattern})$")


def prefix(value: Column, length: int, *, strict: bool = False) -> Column:
    """The first ``length`` characters; a shorter value is an error if ``strict``, else itself."""
    if not strict:
        return F.substring(value, 1, length)
    return F.when(F.length(value) < length, F.raise_error(F.concat(F.lit("shorter than the prefix: "), value))).otherwise(F.substring(value, 1, length))


def number(value: Column, kind: str = "double", *, lenient: bool = False) -> Column:
    """The value as a number; what is none is an error, or null if ``lenient``."""
    return value.try_cast(kind) if lenient else value.cast(kind)


def numeric_fields(line: Column, *, drop: int, drop_right: int) -> Column:
    """White-space separated tokens without the first ``drop`` and last ``drop_right``, as doubles; null if one is no number."""
    tokens = words(line)
    kept = F.slice(tokens, drop + 1, F.greatest(F.size(tokens) - drop - drop_right, F.lit(0)))
    return F.when(F.forall(kept, lambda t: full_match(t, r"\d+(\.\d+)?")), F.transform(kept, lambda t: t.try_cast("double")))
