"""Gradient descent and k-means: each iteration is one aggregate over the rows; the driver holds only the model."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.names import unused
from weftline.operators.linalg import WIDEST, dot_arrays, element_aggregates, squared_distance


def _literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def gradient(points: DataFrame, weights: Sequence[float], error: Callable[[Column, Column], Column], x: str = "x", y: str = "y") -> DataFrame:
    """(pos, g): the mean over rows of error(w.x, y) * x, by position; partial sums leave each task.

    One aggregate a position, so rows are not multiplied; very wide ones are exploded.
    """
    rows = points.select(F.col(x).alias("x"), error(dot_arrays(F.col(x), _literal(weights)), F.col(y)).alias("e"))
    if len(weights) > WIDEST:
        return rows.select("e", F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.avg(F.col("e") * F.col("v")).alias("g"))
    means = element_aggregates("x", len(weights), lambda v: F.avg(F.col("e") * v))
    return rows.agg(means.alias("g")).select(F.posexplode("g").alias("pos", "g")).filter("g is not null")


def squared_error(p: Column, y: Column) -> Column:
    return p - y


def logistic_error(p: Column, y: Column) -> Column:
    """For labels 0 and 1."""
    return 1 / (1 + F.exp(-p)) - y


def descend(points: DataFrame, weights: Sequence[float], error: Callable, *, rate: float, iterations: int, x: str = "x", y: str = "y") -> list[float]:
    """Weights after ``iterations`` steps. Cache ``points`` if they cost more to read than to keep."""
    w = [float(v) for v in weights]
    for _ in range(iterations):
        g = {r["pos"]: r["g"] for r in gradient(points, w, error, x, y).collect()}
        w = [v - rate * g.get(i, 0.0) for i, v in enumerate(w)]
    return w


def linear_regression(points: DataFrame, weights: Sequence[float], *, rate: float = 0.1, iterations: int = 10, x: str = "x", y: str = "y") -> list[float]:
    return descend(points, weights, squared_error, rate=rate, iterations=iterations, x=x, y=y)


def logistic_regression(points: DataFrame, weights: Sequence[float], *, rate: float = 0.1, iterations: int = 10, x: str = "x", y: str = "y") -> list[float]:
    return descend(points, weights, logistic_error, rate=rate, iterations=iterations, x=x, y=y)


def assign(points: DataFrame, centres: Sequence[Sequence[float]], x: str = "x") -> DataFrame:
    """``points`` with ``cluster``, the closest centre, the first of equally close ones, and ``distance`` (squared)."""
    best = F.array_min(F.array(*[F.struct(squared_distance(F.col(x), _literal(c)).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]))
    held = unused(points, stem="best")
    return points.withColumn(held, best).withColumn("cluster", F.col(f"{held}.i")).withColumn("distance", F.col(f"{held}.d")).drop(held)


def centre_step(points: DataFrame, centres: Sequence[Sequence[float]], x: str = "x") -> DataFrame:
    """(cluster, pos, v): the means of the points assigned to each centre."""
    placed, width = assign(points.select(F.col(x).alias("x")), centres, "x"), max(map(len, centres))
    if width > WIDEST:
        return placed.select("cluster", F.posexplode("x").alias("pos", "v")).groupBy("cluster", "pos").agg(F.avg("v").alias("v"))
    means = element_aggregates("x", width, F.avg)
    return placed.groupBy("cluster").agg(means.alias("m")).select("cluster", F.posexplode("m").alias("pos", "v")).filter("v is not null")


def k_means(points: DataFrame, centres: Sequence[Sequence[float]], *, iterations: int = 10, tolerance: float = 0.0, x: str = "x") -> list[list[float]]:
    """Centres after at most ``iterations`` steps; a centre without points stays where it is."""
    now = [[float(v) for v in c] for c in centres]
    for _ in range(iterations):
        new = [list(c) for c in now]
        for r in centre_step(points, now, x).collect():
            new[r["cluster"]][r["pos"]] = r["v"]
        moved = max((a - b) ** 2 for c, d in zip(now, new, strict=True) for a, b in zip(c, d, strict=True))
        now = new
        if moved <= tolerance:
            break
    return now
