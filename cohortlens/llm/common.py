"""What the training-data operators share: tables in the shared folder and access to text as bytes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a numpy kernel takes at a time, unless one text alone is longer.
PIECE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset and master is local, a new one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of `written` that nothing reads any more, whole as they were read back."""
    for table in tables:
        spark = table.sparkSession
        top = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
        files = spark._jvm.org.apache.hadoop.fs.Path
        for path in {files(f).getParent().toString() for f in table.inputFiles()}:
            store = files(path).getFileSystem(spark._jsc.hadoopConfiguration())
            if store.makeQualified(files(path)).getParent() == store.makeQualified(top):
                store.delete(files(path), True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go when it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def sent_if_small(df: DataFrame, most: int = 1 << 20) -> DataFrame:
    """df (already written, rows of a few numbers) marked for broadcast if it has at most `most` rows."""
    return F.broadcast(df) if df.count() <= most else df


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores on end until df has no such column, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def files_of(df: DataFrame, column: str, folder: str, suffix: str, also: list[str] | None = None) -> DataFrame:
    """(path, n_bytes, also) of files that hold one cell of `column` each, written once, here.

    `folder` is a URI. Every attempt of a task writes under names of its own, so what a lost one left is in the folder
    but not in this table: read_files reads by the table.
    """
    kept = df.select(F.col(column).cast("binary"), *(also or []))
    schema = ", ".join(["path string", "n_bytes bigint", *[f"{f.name} {f.dataType.simpleString()}" for f in kept.schema[1:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(path)
        attempt, number = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}", 0
        for batch in batches:
            names = []
            for cell in batch.column(0):
                names.append(f"{path}/part-{attempt}-{number:05d}{suffix}")
                number += 1
                with store.open_output_stream(names[-1], compression=None) as out:
                    out.write(cell.as_py() or b"")
            columns = [pa.array(names, pa.string()), pa.array([len(c.as_py() or b"") for c in batch.column(0)], pa.int64()), *batch.columns[1:]]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "n_bytes", *batch.schema.names[1:]])

    return written(kept.mapInArrow(run, schema), "files")


def read_files(files: DataFrame, folder: str, suffix: str) -> DataFrame:
    """The columns of `files` (of files_of) with the `content` of each, through Spark's reader of binary files."""
    spark = files.sparkSession
    named = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).drop("path", "n_bytes")
    if files.isEmpty():
        return named.withColumn("content", F.lit(None).cast("binary")).drop("name")
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").join(sent_if_small(named), "name").drop("name")


def given_back(run: Callable) -> Callable:
    """A function of batches after which the worker, which stays for later stages, holds no free memory."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return wrapped


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 places where its texts begin and end; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    all_bytes = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return all_bytes[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, most: int = PIECE_BYTES):
    """(first, last + 1) of runs of texts of at most `most` bytes together; a longer text stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[pa.Table]:
    """Rows that come sorted by `keys`: whole groups of equal keys together, `most` rows or little more at a time."""
    held: list[pa.Table] = []
    count, enough = 0, most
    for batch in batches:
        if not len(batch):
            continue
        held.append(pa.Table.from_batches([batch]))
        count += len(batch)
        if count < enough:
            continue
        rows = pa.concat_tables(held).combine_chunks()
        same = np.ones(len(rows), bool)
        for k in keys:
            own = rows[k].to_numpy()
            same &= own == own[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield rows.slice(0, cut).combine_chunks()
        held, count = [rows.slice(cut)], len(rows) - cut
        enough = most if cut else 2 * count
    if count:
        yield pa.concat_tables(held).combine_chunks()


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit words spread over the whole word (xor-shifts and multiplications)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each run of `width` values, by doubling."""
    span, out = 1, x
    while span < width:
        step = min(span, width - span)
        out = np.minimum(out[: len(out) - step], out[step:])
        span += step
    return out
