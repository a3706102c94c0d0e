"""Token ids in binary shards: fixed-size blocks, transposed to byte or bit planes, zstandard, chunk index.

A shard file is: magic; the compressed planes of each block; the footer (a zstandard-compressed
JSON object with the document table and the chunk index); the footer's length as 8 bytes; magic.
All integers are little-endian. The chunk index has for each block its place, its number of ids
and the compressed length of each plane, so that any block is read without the others. The
folder's ``index.json`` lists shards in order with the ids and documents before each.

Shards are written by the executors through Arrow file systems into the shared folder, under a
name of the attempt, and renamed when whole: a lost executor leaves no half shard behind.

Defined cases: a null text is empty and gets the end id alone; null ids sort first; repeated
ids follow each other by text; an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.shared import arrow_map, partitions_for, settle, slices
from weftline.llm.tokens import tokenizer

MAGIC = b"WLPLANE1"
BLOCK = 65_536
#: Bytes of input that a shard holds about, so that a task's work and its document table stay bounded.
SHARD_BYTES = 64 << 20
DOCS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int64())])


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """uint32 ids by significance: 4 byte planes, or 32 bit planes of 8 ids a byte."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(parts: list[bytes], n: int) -> np.ndarray:
    if len(parts) == 4:
        return np.stack([np.frombuffer(p, np.uint8) for p in parts], axis=1).reshape(-1).view("<u4")
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in parts], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


class ShardWriter:
    """Streams documents into one shard; at most a block of ids and the document table are held."""

    def __init__(self, out, planes: str = "byte", block: int = BLOCK, level: int = 3):
        self.out, self.planes, self.block = out, planes, block
        self.zip = zstandard.ZstdCompressor(level=level)
        self.held, self.n_held, self.at, self.n_ids = [], 0, len(MAGIC), 0
        self.chunks: list[list] = []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            all_ids = np.concatenate(self.held)
            whole = len(all_ids) // self.block * self.block
            for at in range(0, whole, self.block):
                self._flush(all_ids[at : at + self.block])
            self.held, self.n_held = [all_ids[whole:].copy()], len(all_ids) - whole

    def _flush(self, ids: np.ndarray) -> None:
        packed = [self.zip.compress(p) for p in to_planes(ids, self.planes)]
        self.chunks.append([self.at, len(ids), [len(p) for p in packed]])
        for p in packed:
            self.out.write(p)
            self.at += len(p)
        self.n_ids += len(ids)

    def close(self) -> None:
        if self.n_held:
            self._flush(np.concatenate(self.held))
        b64 = lambda a: base64.b64encode(np.asarray(a, "<i8").tobytes()).decode()
        footer = {
            "planes": self.planes, "ids": self.n_ids, "chunks": self.chunks, "lengths": b64(self.lengths),
            "doc_ids": b64([d or 0 for d in self.doc_ids]), "null_ids": [i for i, d in enumerate(self.doc_ids) if d is None],
        }
        packed = self.zip.compress(json.dumps(footer).encode())
        self.out.write(packed + len(packed).to_bytes(8, "little") + MAGIC)


class ShardReader:
    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = self._read(size - 16, 16)
        if tail[8:] != MAGIC or self._read(0, 8) != MAGIC:
            raise ValueError("not a token shard, or cut short")
        n = int.from_bytes(tail[:8], "little")
        self.zip = zstandard.ZstdDecompressor()
        self.footer = json.loads(self.zip.decompress(self._read(size - 16 - n, n)))
        self.lengths = np.frombuffer(base64.b64decode(self.footer["lengths"]), "<i8")
        doc_ids = np.frombuffer(base64.b64decode(self.footer["doc_ids"]), "<i8").tolist()
        for i in self.footer["null_ids"]:
            doc_ids[i] = None
        self.doc_ids = doc_ids

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def chunk(self, k: int) -> np.ndarray:
        at, n, sizes = self.footer["chunks"][k]
        raw, parts = self._read(at, sum(sizes)), []
        for size in sizes:
            parts.append(self.zip.decompress(raw[:size]))
            raw = raw[size:]
        return from_planes(parts, n)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Each document's id and token ids, in order; about a block is held beside the document."""
        held, k = np.empty(0, "<u4"), 0
        for doc_id, n in zip(self.doc_ids, self.lengths.tolist(), strict=True):
            if len(held) < n:
                parts, have = [held], len(held)
                while have < n:
                    parts.append(self.chunk(k))
                    have, k = have + len(parts[-1]), k + 1
                held = np.concatenate(parts)
            yield doc_id, held[:n]
            held = held[n:]


def _open(uri: str):
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    return fs, path


def write_tokens(df: DataFrame, path: str, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, planes: str = "byte", block: int = BLOCK, shards: int | None = None) -> list[dict]:
    """Encode every whole text, append ``end_id``, and write shards to ``path`` (a URI) in ascending id order.

    Returns the entries of ``index.json``, one per shard: file, shard, docs, ids, docs_before, ids_before.
    """
    spark = df.sparkSession
    n = shards or partitions_for(df, SHARD_BYTES)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def write(batches):
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}.wlp"
        tok = tokenizer(vocabulary)
        fs, folder = _open(path)
        fs.create_dir(folder, recursive=True)
        part = f"{folder}/.{name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as out:
            writer = ShardWriter(out, planes, block)
            for batch in batches:
                for rows in slices(batch, 1, 1 << 22):
                    for doc_id, ids in zip(rows.column(0).to_pylist(), tok.encode(rows.column(1)), strict=True):
                        writer.add(doc_id, np.frombuffer(ids + tail, "<u4"))
            writer.close()
        if writer.doc_ids:
            settle(fs, part, f"{folder}/{name}")
            yield pa.RecordBatch.from_pylist([{"shard": shard, "file": name, "docs": len(writer.doc_ids), "ids": writer.n_ids}])
        else:
            fs.delete_file(part)

    entries = sorted((r.asDict() for r in arrow_map(rows, write, "shard long, file string, docs long, ids long").collect()), key=lambda e: e["shard"])
    docs = ids = 0
    for e in entries:
        e |= {"docs_before": docs, "ids_before": ids}
        docs, ids = docs + e["docs"], ids + e["ids"]
    fs, folder = _open(path)
    fs.create_dir(folder, recursive=True)
    for left in fs.get_file_info(pyarrow.fs.FileSelector(folder)):  # of attempts that died
        if left.base_name.startswith("."):
            fs.delete_file(left.path)
    with fs.open_output_stream(f"{folder}/index.json") as out:
        out.write(json.dumps({"format": MAGIC.decode(), "documents": docs, "ids": ids, "shards": entries}).encode())
    return entries


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """What the shards at ``path`` hold, a row per document: doc_id, start, n_tokens, ids_crc32, shard."""
    fs, folder = _open(path)
    with fs.open_input_stream(f"{folder}/index.json") as f:
        entries = json.loads(f.read())["shards"]
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long, shard long"
    if not entries:
        return spark.createDataFrame([], ddl)
    files = spark.createDataFrame([(e["shard"], e["file"], e["ids_before"]) for e in entries], "shard long, file string, before long")
    files = files.repartitionByRange(len(entries), "shard")

    def read(batches):
        for batch in batches:
            for shard, name, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, folder = _open(path)
                with fs.open_input_file(f"{folder}/{name}") as f:
                    out = []
                    for doc_id, ids in ShardReader(f).documents():
                        out.append((doc_id, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()), shard))
                        start += len(ids)
                        if len(out) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=DOCS_SCHEMA)
                            out = []
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=DOCS_SCHEMA)

    return arrow_map(files, read, ddl)
