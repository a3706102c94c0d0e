"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, components.

A document's set holds the hashes of its distinct shingles of ``width`` words. Documents with
equal sets are one node from the start, so copies never meet in a band. Nodes that share a band
are compared on full sets as ``banding`` has it: every pair that shares a band is linked directly
or connected by way of others. With 32 bands of 4 rows, a pair with similarity 0.8 shares none
with probability 5e-8; in blocks, a pair whose signatures agree in fewer slots than 5.3 standard
deviations below the similarity is passed over, which a similar pair is with probability 1e-7.

Defined cases: null and empty texts, or texts without words, have an empty set and are linked
with nothing; a row with a null id is linked with nothing and has a null component; rows that
repeat an id are documents of their own, each with its text's group, and stay where it is the
smallest of that group; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.banding import agree, components_of_bands
from weftline.llm.minhash import band_keys, superminhash
from weftline.llm.shared import arrow_map, drop_written, slices, unused, written
from weftline.llm.words import shingles, utf8, word_hashes

def _sets(column: pa.Array, width: int) -> list[np.ndarray]:
    hashes, ends = word_hashes(*utf8(column))
    parts, ends = shingles(hashes, ends, width)
    return [np.unique(parts[x:y]) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _described(rows: DataFrame, width: int, slots: int, band_rows: int) -> DataFrame:
    """id, copy, n, print (of the set), bands, sig (the low byte of each slot) of rows (id, copy, text)."""

    def describe(batches):
        for batch in batches:
            for part in slices(batch, 2, 1 << 19):
                sets = _sets(part.column(2), width)
                n = [len(s) for s in sets]
                sig = superminhash(np.concatenate(sets), np.concatenate(([0], np.cumsum(n))), slots)
                keys = band_keys(sig, band_rows)
                low = (sig & np.uint32(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1], keys.reshape(-1)), pa.array([s.tobytes() for s in low], pa.binary()),
                    ], names=["id", "copy", "n", "print", "bands", "sig"],
                )

    return arrow_map(rows, describe, "id long, copy long, n long, print binary, bands array<long>, sig binary")


def similar_sets(percent: int):
    def similar(a: np.ndarray, b: np.ndarray) -> bool:
        if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
            return False
        both = np.intersect1d(a, b, assume_unique=True).size
        return bool(100 * both >= percent * (len(a) + len(b) - both))

    return similar


def _grouped(df: DataFrame, id_col: str, text_col: str, width: int, percent: int, bands: int, band_rows: int) -> DataFrame:
    """A row per row of ``df``: id, copy (a hash of the text), n, component_id."""
    slots = bands * band_rows
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("copy"), F.col(text_col).alias("text"))
    sets = written(_described(rows, width, slots, band_rows), "sets")
    usable = sets.filter("n > 0 and id is not null")
    # classes of equal sets, numbered; the first of their rows gives each its text
    classes = usable.groupBy("print").agg(F.min(F.struct("id", "copy")).alias("first"))
    classes = written(classes.select("print", "first.*", F.monotonically_increasing_id().alias("node")), "classes")
    nodes = usable.join(classes.select("node", "id", "copy"), ["id", "copy"]).dropDuplicates(["node"])
    nodes = written(nodes.select("node", "id", "copy", "n", "bands", "sig"), "nodes")
    banded = nodes.select("node", F.col("n").alias("size"), F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    members = written(banded.join(shared, "key"), "members")
    wanted = nodes.select("node", "id", "copy").join(members.select("node").distinct(), "node", "left_semi")
    texts = written(rows.join(wanted, ["id", "copy"]).select("node", "text").dropDuplicates(["node"]), "texts")
    share = percent / 100
    least = int((share - 5.3 * (share * (1 - share) / slots) ** 0.5) * slots)
    labels = components_of_bands(members, lambda some: nodes.join(some, "node"), texts, agree(least), lambda column: _sets(column, width), similar_sets(percent))
    drop_written(members, texts, nodes)
    tops = classes.join(labels, "node", "left").select("print", "id", F.coalesce("label", "node").alias("label"))
    smallest = tops.groupBy("label").agg(F.min("id").alias("component_id"))
    tops = written(tops.join(smallest, "label").select("print", "component_id"), "tops")
    drop_written(classes, labels)
    linked = usable.select("id", "copy", "n", "print").join(tops, "print").select("id", "copy", "n", "component_id")
    alone = sets.filter("n = 0 or id is null").select("id", "copy", "n", F.col("id").alias("component_id"))
    return linked.unionByName(alone)


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, percent: int = 80, bands: int = 32, band_rows: int = 4) -> DataFrame:
    """One row per row of ``df``: ``id_col``, n_shingles, component_id, kept.

    Documents are linked where 100 * intersection >= ``percent`` * union of their sets;
    component_id is the smallest id reachable through links. Words are runs of anything but
    space and 0x09-0x0D, with A-Z lower-cased.
    """
    out = _grouped(df, id_col, text_col, width, percent, bands, band_rows)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, percent: int = 80, bands: int = 32, band_rows: int = 4) -> DataFrame:
    """The rows of ``df`` whose id is the smallest of its group, with all columns; rows without an id stay."""
    gone, copy = unused(df, "gone"), unused(df, "copy")
    dropped = _grouped(df, id_col, text_col, width, percent, bands, band_rows).filter("id <> component_id").select(F.col("id").alias(gone), F.col("copy").alias(copy)).distinct()
    return df.join(dropped, (F.col(f"`{id_col}`") == F.col(gone)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(copy)), "left_anti")
