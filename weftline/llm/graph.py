"""Connected components by DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import drop_written, release, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for each node with an edge; the label is the smallest node of its component.

    Each round takes the smallest label among neighbours, then the label of that label, so that
    depth halves; tables between rounds are written to the shared folder, which cuts lineage. A
    node with very many edges is no hot group: its edges meet in partial minima, and the join
    on it may be split. Null ends and loops are no edges; no edges give an empty table.
    """
    pairs = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).filter("node is not null and other is not null and node <> other")
    pairs = written(pairs.unionByName(pairs.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    labels = written(pairs.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        seen = labels.select(F.col("node").alias("other"), F.col("label").alias("l"))
        near = pairs.join(seen, "other").groupBy("node").agg(F.min("l").alias("m"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("up"))
        jump = labels.select(F.col("node").alias("up"), F.col("label").alias("top"))
        moved = written(lower.join(jump, "up").select("node", "old", F.least("up", "top").alias("label")), "labels")
        changed = moved.filter("old <> label").limit(1).count()
        drop_written(labels)
        release(edges.sparkSession)
        labels = moved.select("node", "label")
        if not changed:
            drop_written(pairs)
            return labels
