"""Exact dedup: 128-bit content hash groups, compared byte for byte. Native: no Python on the main path.

``groupBy(hash, text)`` is the byte comparison: the hash deals the rows, the text inside the
key separates colliding ones, and the partial aggregate reduces the copies of a task to one
row before the shuffle, so a group that holds a third of all rows costs one row a task.

Defined cases: a null text is the empty text; a null id is smaller than any id and stays only
where its group has no other; rows that repeat id and text count each in ``group_size`` and
share their ``kept``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import written


def content_hash(text: Column) -> Column:
    """The 128-bit hash that groups rows."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep: str = "smallest", hash128=content_hash) -> DataFrame:
    """One row per row of ``df``: ``id_col``, keep_id, group_size, kept, text_sha256.

    ``keep`` is which id of equal texts stays: "smallest" or "largest". ``hash128`` may be any
    deterministic hash: collisions are told apart by the texts, and the result's rows find
    their class by the hash together with the SHA-256.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    pick = F.min if keep == "smallest" else F.max
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("_id"), text.alias("_text"))
    sha = F.sha2(F.col("_text").cast("binary"), 256)
    classes = rows.groupBy(hash128(F.col("_text")).alias("_h"), "_text").agg(pick("_id").alias("_keep"), F.count("*").alias("_n"))
    classes = (
        classes.select("_h", sha.alias("_sha"), "_keep", "_n")
        .groupBy("_h", "_sha")
        .agg(pick("_keep").alias("_keep"), F.sum("_n").alias("_n"), F.count("*").alias("_classes"))
        .withColumn("_n", F.when(F.col("_classes") == 1, F.col("_n")).otherwise(F.raise_error(F.lit("two texts share both hashes")).cast("long")))
    )
    # as a written table both sides of the join are plain exchanges, so a hot class can be split
    classes = written(classes.select("_h", "_sha", "_keep", "_n"), "classes")
    keyed = rows.select("_id", hash128(F.col("_text")).alias("_h"), sha.alias("_sha"))
    return keyed.join(classes, ["_h", "_sha"]).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, keep: str = "smallest", hash128=content_hash) -> DataFrame:
    """The rows of ``df`` that stay, with all columns: one for each distinct text.

    Of rows that repeat the kept id and text, the one whose other columns sort first (last for
    "largest") stays. Null and empty texts are one class; its row keeps the text it had.
    """
    pick = F.min if keep == "smallest" else F.max
    others = [c for c in df.columns if c not in (id_col, text_col)]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    packed = F.struct(F.col(f"`{id_col}`"), *[F.col(f"`{c}`") for c in others], F.col(f"`{text_col}`").isNull().alias("_null"))
    kept = df.select(text.alias("_text"), packed.alias("_row")).groupBy(hash128(F.col("_text")).alias("_h"), "_text").agg(pick("_row").alias("_row"))
    back = F.when(F.col("_row._null"), F.lit(None)).otherwise(F.col("_text"))
    return kept.select(*[(back if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in df.columns])


#: Of equal texts the row with the largest doc_id stays, as the query's contract has it.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
