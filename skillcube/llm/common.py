"""Shared pieces: the scratch folder, written tables, ranges of keys, files that tasks open."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_WORD = r"[^\x20\x09-\x0D]+"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder, named once, under spark.checkpoint.dir (shared by driver and executors).

    Where that setting is absent, a temporary folder is made, which only a local master can use.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    if "://" not in root:
        root = f"file://{root}" if spark.sparkContext.master.startswith("local") else root
    top = _SCOPES[-1] if _SCOPES else f"{root.rstrip('/')}/skillcube/{spark.sparkContext.applicationId}"
    return f"{top}/{label}-{uuid.uuid4().hex}"


_SCOPES: list[str] = []


@contextmanager
def scratch_scope(spark: SparkSession, label: str):
    """Scratch folders named inside are deleted at the end, so what is to stay is written elsewhere."""
    _SCOPES.append(scratch_dir(spark, label))
    try:
        yield
    finally:
        delete(spark, _SCOPES.pop())


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes this application's scratch tables and files; results that still read them are lost."""
    delete(spark, scratch_dir(spark, "x").rsplit("/", 1)[0])


def written(df: DataFrame, label: str, batch_rows: int | None = None) -> DataFrame:
    """df, stored as a table in the scratch folder and read again: cuts lineage, survives lost executors.

    batch_rows: rows of an Arrow batch meanwhile, where rows are large.
    """
    path, conf = scratch_dir(df.sparkSession, label), df.sparkSession.conf
    usual = conf.get(ARROW_ROWS)
    if batch_rows:
        conf.set(ARROW_ROWS, str(batch_rows))
    try:
        df.write.parquet(path)
    finally:
        conf.set(ARROW_ROWS, usual)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession, rows: int) -> None:
    """From now on an Arrow batch of this session has at most `rows` rows: for lazy results whose rows hold texts, so the setting stays."""
    if not 0 < int(spark.conf.get(ARROW_ROWS)) <= rows:
        spark.conf.set(ARROW_ROWS, str(rows))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(df: DataFrame, keys: list[str], parts: int) -> list[tuple]:
    """The least keys of about `parts` even ranges of the rows in order of `keys` (nulls first), as Spark's range partitioning cuts them.

    Only the key columns move, and a row per range comes to the driver. Rows with equal keys stay together, so the
    keys should tell rows apart (an id and a hash of the text).
    """
    rows = df.select(*keys).repartitionByRange(parts, *[F.asc_nulls_first(k) for k in keys])
    first = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*keys)).alias("first")).select("first.*").collect()
    return sorted(map(tuple, first), key=lambda t: [(x is not None, x or 0) for x in t])


def with_range(df: DataFrame, keys: list[str], bounds: list[tuple], out: str = "bucket") -> DataFrame:
    """Adds `out` (int): the number of the last bound that the row's keys (numbers, nulls first) reach (0 below all), by binary search.

    The bounds (some 16 bytes a key) are broadcast once and no row carries them; a recomputed task deals its rows out as the first attempt did.
    """
    if len(bounds) < 2:
        return df.withColumn(out, F.lit(0))
    columns = [c for k in range(len(keys)) for c in (np.array([t[k] is not None for t in bounds[1:]], np.int64), np.array([t[k] or 0 for t in bounds[1:]], np.int64))]
    held = df.sparkSession.sparkContext.broadcast(columns)

    def search(*values):
        mine = [c for v in values for c in (v.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), v.fill_null(0).to_numpy(zero_copy_only=False))]
        lo, hi = np.zeros(len(values[0]), np.int64), np.full(len(values[0]), len(held.value[0]))
        while (between := lo < hi).any():
            mid = (lo + hi) // 2
            at, reached, same = np.minimum(mid, len(held.value[0]) - 1), np.zeros(len(mid), bool), np.ones(len(mid), bool)
            for bound, x in zip(held.value, mine):
                reached |= same & (bound[at] < x)
                same &= bound[at] == x
            up = between & (reached | same)
            lo, hi = np.where(up, mid + 1, lo), np.where(between & ~up, mid, hi)
        return pa.array(lo.astype(np.int32))

    return df.withColumn(out, F.arrow_udf(_of_arrays(search, len(keys)), "int")(*[F.col(k).cast("long") for k in keys]))


def _of_arrays(f, n: int):
    """f with n arguments whose types say that they are Arrow arrays."""
    kinds = {1: lambda a: f(a), 2: lambda a, b: f(a, b), 3: lambda a, b, c: f(a, b, c)}
    kinds[n].__annotations__ = {**dict.fromkeys("abc"[:n], pa.Array), "return": pa.Array}
    return kinds[n]


WHITE = tuple(bytes([c]) for c in b" \t\n\v\f\r")


def pieces(text: bytes, size: int = 1 << 20):
    """A text in pieces of about `size` bytes, cut at ASCII white space: their words are the text's."""
    at = 0
    while len(text) - at > size:
        cut = max(text.rfind(c, at, at + size) for c in WHITE)
        if cut <= at:
            cut = min((x for c in WHITE if (x := text.find(c, at + 1)) >= 0), default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def window_slots(ids: np.ndarray, width: int, of: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the windows of `width` ids, down to about eight times as many values as there are windows (16 million at most), for counting.

    of: a number of each window that its hash is to depend on. Equal windows share a slot; a slot may hold others too.
    """
    n = max(0, len(ids) - width + 1)
    key = np.zeros(n, np.uint64) if of is None else of[:n].astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            key ^= key >> np.uint64(29)
            key *= np.uint64(0x9E3779B97F4A7C15)
            key += ids[k : k + n].astype(np.uint64)
        key *= np.uint64(0xD6E8FEB86659FD93)
    key >>= np.uint64(64 - min(24, n.bit_length() + 3))
    return key.astype(np.int32)


def slices(batches, rows: int = 500):
    """Arrow batches cut into short ones, so that few texts at a time become Python strings."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def trim() -> None:
    """Gives what this worker has freed back to the system: idle workers stand beside the next stage's tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def open_output(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return fs.open_output_stream(path, compression=None)


def open_input(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_stream(path, compression=None)


def read_bytes(uri: str) -> bytes:
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()


def move(src: str, dst: str) -> None:
    """Renames; a repeated call after success does nothing."""
    fs, a = pafs.FileSystem.from_uri(src)
    b = pafs.FileSystem.from_uri(dst)[1]
    if fs.get_file_info(a).type == pafs.FileType.NotFound:
        if fs.get_file_info(b).type == pafs.FileType.NotFound:
            raise FileNotFoundError(src)
        return
    fs.create_dir(b.rsplit("/", 1)[0], recursive=True)
    fs.move(a, b)


def remove(uri: str) -> None:
    """Deletes a folder, if it is there."""
    fs, path = pafs.FileSystem.from_uri(uri)
    if fs.get_file_info(path).type == pafs.FileType.Directory:
        fs.delete_dir(path)
