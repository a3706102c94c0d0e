"""What the operators of this subpackage share: the shared folder, written tables, Arrow maps."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import suppress
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCK = threading.Lock()
_SHIPPED: set[str] = set()
_LEFT: list[tuple] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as named by ``spark.checkpoint.dir``.

    Where the setting is absent, a folder is made: in the machine's temporary folder in
    local mode only, else under the warehouse, which a cluster shares.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    with _LOCK:
        if spark.sparkContext.master.startswith("local"):
            made = tempfile.mkdtemp(prefix="weftline-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            made = Path(made).as_uri()
        else:
            made = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.weftline"
            if made.startswith(("file:", "/")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(made)
    return made


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is there when the driver ends is deleted then."""
    path = f"{shared_dir(spark)}/weftline-{name}-{uuid.uuid4().hex[:12]}"
    if not _LEFT:
        atexit.register(_clear)
    _LEFT.append((spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), spark._jsparkSession.sessionState().newHadoopConf()))
    return path


def _clear() -> None:
    for path, conf in _LEFT:
        try:
            path.getFileSystem(conf).delete(path, True)
        except Exception:  # the JVM is gone
            return


def fresh_uri(spark: SparkSession, name: str) -> str:
    """A fresh path with its scheme, as Arrow's file systems want it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(fresh_path(spark, name))
    uri = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder; its lineage ends there."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared folder, if it is there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def drop_written(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            drop_folder(df.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Let the driver forget finished plans now, so that Spark deletes their shuffle files on the executors' disks."""
    gc.collect()
    # Py4J tells the JVM of what Python has let go up to a second later; till then the plans are in use there
    late = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)
    while late:
        try:
            gone = late.pop()
        except IndexError:
            break
        if not isinstance(gone, tuple):  # the worker's sign to end
            late.append(gone)
            break
        client, target = gone
        client.garbage_collect_object(target, False)
    # listeners' threads hold the end of the last query, and so its plan, until another one ends
    spark.sql("SELECT 1").collect()
    with suppress(Exception):
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(5_000)
    spark.sparkContext._jvm.System.gc()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, whatever the driver's import path."""
    sc = spark.sparkContext
    with _LOCK:
        if sc.applicationId in _SHIPPED:
            return
        top = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="weftline-code-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        target = os.path.join(folder, "weftline.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, str(p.relative_to(top.parent)))
        sc.addPyFile(target)
        _SHIPPED.add(sc.applicationId)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def by_runs(df: DataFrame, keys: list[str], fn: Callable[[pa.Table, list[tuple[int, int]]], list[pa.Table | None]], schema: str, spread: bool = False) -> DataFrame:
    """``fn`` of the groups of rows with equal, non-null ``keys``, which must be bounded, several at once: a table and where its groups begin and end. None stands for no rows.

    Rows are sorted in their partition and handed on as they come, so that many small groups cost
    little each: a task holds one batch and the group that it cuts. Where groups of few bytes take
    long, ``spread`` deals them over all partitions, which Spark else puts together by their bytes.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    parsed = _parse_datatype_string(schema)
    target = to_arrow_schema(parsed if isinstance(parsed, StructType) else StructType.fromDDL(schema))

    def of_groups(table: pa.Table):
        done = [d for d in fn(table, _runs_of(table, keys)) if d is not None and d.num_rows]
        if done:
            yield from pa.concat_tables(done).cast(target).combine_chunks().to_batches()

    def stream(batches):
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            last = _runs_of(table, keys)[-1][0]
            if last:
                yield from of_groups(table.slice(0, last))
            held = table.slice(last)
        if held is not None:
            yield from of_groups(held)

    spark = df.sparkSession
    parts = [max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)] * spread
    return arrow_map(df.repartition(*parts, *keys).sortWithinPartitions(*keys), stream, schema)


def _runs_of(table: pa.Table, keys: list[str]) -> list[tuple[int, int]]:
    """Where runs of rows with equal keys begin and end."""
    import numpy as np

    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in keys:
        codes = table.column(k).combine_chunks().dictionary_encode().indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    at = np.flatnonzero(new).tolist()
    return list(zip(at, [*at[1:], table.num_rows], strict=True))


def unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` has not."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, column: int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose strings hold about ``max_bytes`` together; a longer row stands alone."""
    import numpy as np
    import pyarrow.compute as pc

    n = batch.num_rows
    if not n:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield batch.slice(at, to - at)
        at = to


def settle(fs, part: str, name: str) -> None:
    """Give a whole file its name. If another attempt of the task has done so, its file is the same and stays."""
    import pyarrow.fs

    try:
        fs.move(part, name)
    except OSError:
        if fs.get_file_info(name).type != pyarrow.fs.FileType.File:
            raise
        fs.delete_file(part)


def partitions_for(df: DataFrame, each_bytes: int) -> int:
    """How many partitions of about ``each_bytes`` hold what ``df`` reads; at least the session's.

    The files' sizes are what the planner knows of them; sources without a known size are read once.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    total = sum(sizes)
    if any(s >= 1 << 60 for s in sizes):  # the planner's "unknown"
        strings = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)).cast("long") for f in df.schema if f.dataType.typeName() in ("string", "binary")]
        total = df.agg(F.coalesce(F.sum(sum(strings, F.lit(16).cast("long"))), F.lit(0))).first()[0]
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1, -(-total // each_bytes))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
