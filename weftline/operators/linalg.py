"""Distributed vectors (idx, v) and matrices of rows (idx, row)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.reducers import Reducer, reducer

IDX, V, ROW = "idx", "v", "row"
#: Columns that are aggregated one by one in a row; wider rows, whose aggregates go beyond generated code, are exploded into cells.
WIDEST = 32


def element_aggregates(array: str, width: int, how: Callable[[Column], Column]) -> Column:
    """An array of one aggregate for each of the first ``width`` elements."""
    return F.array(*[how(F.get(F.col(array), F.lit(i)).cast("double")) for i in range(width)])


def local_vector(spark, values: Sequence[float]) -> DataFrame:
    """A local sequence as a vector indexed from 0."""
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(values)], f"{IDX} long, {V} double")


def _pair(a: DataFrame, b: DataFrame, how: str, f: Callable[[Column, Column], Column]) -> DataFrame:
    b = b.select(IDX, F.col(V).alias("_w"))
    zero = F.lit(0.0)
    return a.join(b, IDX, how).select(IDX, f(F.coalesce(V, zero), F.coalesce("_w", zero)).alias(V))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum; an index that one side lacks counts as 0 there."""
    return _pair(a, b, "full_outer", lambda x, y: x + y)


def times(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product by element; an index that one side lacks gives 0."""
    return _pair(a, b, "full_outer", lambda x, y: x * y)


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Difference at the indexes both sides have."""
    return _pair(a, b, "inner", lambda x, y: x - y)


def map_elements(a: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return a.select(IDX, f(F.col(V)).alias(V))


def scale(a: DataFrame, by: float) -> DataFrame:
    return map_elements(a, lambda x: x * by)


def shift(a: DataFrame, by: float) -> DataFrame:
    return map_elements(a, lambda x: x + by)


def negate(a: DataFrame) -> DataFrame:
    return map_elements(a, lambda x: -x)


def inner(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the dot product as ``value``."""
    return a.join(b.select(IDX, F.col(V).alias("_w")), IDX).agg(F.coalesce(F.sum(F.col(V) * F.col("_w")), F.lit(0.0)).alias("value"))


def reduce(a: DataFrame, how: Reducer) -> DataFrame:
    return a.agg(reducer(how)(F.col(V)).alias("value"))


def size(a: DataFrame) -> int:
    return a.count()


def concat(a: DataFrame, b: DataFrame, size_of_a: int | None = None) -> DataFrame:
    """``b`` after ``a``; the size of ``a`` is counted unless given."""
    n = a.count() if size_of_a is None else size_of_a
    return a.select(IDX, V).unionByName(b.select((F.col(IDX) + n).alias(IDX), V))


def cut(a: DataFrame, start: int, length: int | None = None, *, strict: bool = False) -> DataFrame:
    """Elements from ``start``, ``length`` of them or all; ``strict`` leaves out ``start`` itself, ends as before."""
    low = F.col(IDX) > start if strict else F.col(IDX) >= start
    return a.filter(low if length is None else low & (F.col(IDX) < start + length))


# matrices


def map_rows(m: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return m.select(IDX, f(F.col(ROW)).alias(ROW))


def map_cells(m: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return map_rows(m, lambda r: F.transform(r, f))


def zip_rows(m: DataFrame, vector: DataFrame, f: Callable[[Column, Column], Column]) -> DataFrame:
    """``f(cell, v)`` of each cell with the vector's element at the row's index; rows without one are left out."""
    return m.join(vector.select(IDX, V), IDX).select(IDX, F.transform(ROW, lambda x: f(x, F.col(V))).alias(ROW))


def dot(m: DataFrame, vector: Sequence[float]) -> DataFrame:
    """The product with a local vector, as a vector."""
    w = F.array(*[F.lit(float(x)) for x in vector])
    return m.select(IDX, dot_arrays(F.col(ROW), w).alias(V))


def dot_arrays(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def cells(m: DataFrame) -> DataFrame:
    """(idx, col, x)."""
    return m.select(IDX, F.posexplode(ROW).alias("col", "x"))


def reduce_rows(m: DataFrame, how: Reducer = "sum", *, width: int | None = None) -> DataFrame:
    """The element-wise reduction over rows: a vector with one element per column; a known ``width`` saves exploding the rows."""
    if width is not None and width <= WIDEST:
        return m.agg(element_aggregates(ROW, width, reducer(how)).alias(ROW)).select(F.posexplode(ROW).alias("p", V)).select(F.col("p").cast("long").alias(IDX), V)
    return cells(m).groupBy("col").agg(reducer(how)(F.col("x")).alias(V)).select(F.col("col").cast("long").alias(IDX), V)


def reduce_columns(m: DataFrame, step: Callable[[Column, Column], Column] = lambda s, x: s + x, zero: float = 0.0) -> DataFrame:
    """The fold within each row from ``zero``: a vector with one element per row."""
    return m.select(IDX, F.aggregate(F.transform(ROW, lambda x: x.cast("double")), F.lit(zero), step).alias(V))


def total(m: DataFrame) -> DataFrame:
    return reduce(reduce_columns(m), "sum")


def num_rows(m: DataFrame) -> int:
    return m.count()


def num_columns(m: DataFrame) -> int:
    """The largest row's size; 0 without rows."""
    return m.agg(F.max(F.size(ROW))).first()[0] or 0


def row(m: DataFrame, i: int) -> DataFrame:
    """Row ``i`` as a vector."""
    return m.filter(F.col(IDX) == i).select(F.posexplode(ROW).alias("p", V)).select(F.col("p").cast("long").alias(IDX), V)


def col(m: DataFrame, j: int) -> DataFrame:
    """Column ``j`` as a vector."""
    return m.select(IDX, F.get(ROW, F.lit(j)).alias(V))


def map_each_column(m: DataFrame, f: Callable[[list[float]], list[float]]) -> DataFrame:
    """Each column by a Python function of the whole column, in the order of ``idx``, to a column of the same size.

    A column meets in one task; use ``map_columns`` where a column's statistics do. Rows must be equally wide.
    """
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values([IDX])
        out = [float(x) for x in f(ordered["x"].tolist())]
        return pd.DataFrame({IDX: ordered[IDX], "col": ordered["col"], "x": out})

    columns = cells(m).select(IDX, "col", F.col("x").cast("double").alias("x")).groupBy("col").applyInPandas(one, "idx long, col int, x double")
    rows = columns.groupBy(IDX).agg(F.sort_array(F.collect_list(F.struct("col", "x"))).alias("r"))
    return rows.select(IDX, F.transform("r", lambda c: c["x"]).alias(ROW))


def map_columns(m: DataFrame, f: Callable[[Column, Column], Column], **stats: Callable[[Column], Column]) -> DataFrame:
    """Each cell by ``f(cell, column's statistics)``, where ``stats`` are aggregates over the column.

    The statistics are one row per column, which is an array as wide as a row of the matrix.
    """
    by_col = cells(m).groupBy("col").agg(*[s(F.col("x").cast("double")).alias(n) for n, s in stats.items()])
    packed = by_col.agg(F.sort_array(F.collect_list(F.struct("col", *stats))).alias("_s"))
    return m.crossJoin(F.broadcast(packed)).select(IDX, F.zip_with(ROW, "_s", f).alias(ROW))


def normalised(m: DataFrame) -> DataFrame:
    """Each cell minus its column's mean, over the root of the column's sum of squares (0 where that is 0)."""
    return map_columns(m, lambda x, s: F.when(s["q"] > 0, (x.cast("double") - s["mean"]) / F.sqrt(s["q"])).otherwise(0.0), mean=F.avg, q=lambda x: F.sum(x * x))
