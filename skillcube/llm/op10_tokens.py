"""Token-ID output: shards of raw ids in key order, each with a minimal perfect hash index.

Rows are dealt out by ranges of (key, hash of the text), sorted, encoded and streamed to files of bounded payload, so a task
holds one shard at most, whatever key repeats. A file gets a name of its own per attempt; the manifest, a table that Spark
commits, says which files count. Null texts have no ids but the end id. Rows without a key come
first; equal keys stay apart as records of one index entry of each file that has some (in order of a hash of the text, then
the text); rows equal in key and text stay in one range, which streams them into as many files as they need. A very long text is one record and may exceed a file's usual size. Extra columns are left aside. An empty table
gives an empty manifest.

`lookup` deals keys out by ranges, finds a key's files by binary search in the files' sorted key ranges, and reads of a file its index,
then of each record its two offsets and its ids.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import idfile
from .common import open_output, read_bytes, scratch_dir, shuffle_partitions, slices, table, written
from .tokens import encoder

SHARD_BYTES = 32 << 20
END_ID = 1
MANIFEST = "bucket int, seq int, uri string, n_records long, n_tokens long, n_null long, min_key long, max_key long, bytes long"


def write_ids(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards; returns the manifest: a row per file, in key order by (bucket, seq), with `start`."""
    spark = docs.sparkSession
    folder, n = scratch_dir(spark, "ids"), shuffle_partitions(spark)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    order = [F.asc_nulls_first("key"), F.xxhash64("text")]

    def write(batches):
        from pyspark import TaskContext

        bucket = TaskContext.get().partitionId()
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        out, keys, nulls, lengths, size, seq, name = None, [], 0, [], 0, 0, ""

        def close():
            nonlocal out, keys, nulls, lengths, size, seq
            parts, counts = idfile.footer(np.array(keys, np.int64), nulls, np.array(lengths, np.int64))
            tail = parts + idfile.head(enc.width, size, counts)
            out.write(tail)
            out.close()
            row = [bucket, seq, name, len(lengths), sum(lengths), nulls, keys[0] if keys else None, keys[-1] if keys else None, size + len(tail)]
            out, keys, nulls, lengths, size, seq = None, [], 0, [], 0, seq + 1
            return pa.RecordBatch.from_pydict({f.split()[0]: [v] for f, v in zip(MANIFEST.split(", "), row)}, schema=SCHEMA)

        for batch in slices(batches):
            for k, t in zip(batch["key"].to_pylist(), batch["text"]):
                if out is not None and size >= shard_bytes:
                    yield close()
                if out is None:
                    name = f"{folder}/{bucket:06d}-{seq:04d}-{uuid.uuid4().hex}.ids"
                    out = open_output(name)
                raw = enc.encode(t.as_py()) + end
                out.write(raw)
                size += len(raw)
                lengths.append(len(raw) // enc.width)
                if k is None:
                    nulls += 1
                else:
                    keys.append(k)
        if out is not None:
            yield close()

    SCHEMA = pa.schema([("bucket", pa.int32()), ("seq", pa.int32()), ("uri", pa.string()), *[(c, pa.int64()) for c in ("n_records", "n_tokens", "n_null", "min_key", "max_key", "bytes")]])
    files = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text").mapInArrow(write, MANIFEST)
    files = written(files, "ids-files")
    before = Window.orderBy("bucket", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return written(files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), "ids-manifest")


def read_ids(manifest: DataFrame) -> DataFrame:
    """A row per record of the files: key, start (ids before it), n_tokens, ids_crc32, reached through the index."""

    def read(batches):
        for batch in batches:
            for uri, start in zip(batch["uri"].to_pylist(), batch["start"].to_pylist()):
                shard = idfile.Shard(read_bytes(uri))
                at = list(range(shard.n_null))
                keys = np.unique(shard.keys)
                first, count = shard.records(keys)
                if (count < 1).any():
                    raise ValueError(f"{uri}: a key is missing from the index")
                at += [i for f, c in zip(first.tolist(), count.tolist()) for i in range(f, f + c)]
                crc = [zlib.crc32(shard.record(i).astype("<u4").tobytes()) for i in at]
                at = np.array(at, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None] * shard.n_null + np.repeat(keys, count).tolist(), pa.int64()), pa.array(start + shard.offsets[at]), pa.array(shard.offsets[at + 1] - shard.offsets[at]), pa.array(crc, pa.int64())],
                    names=["key", "start", "n_tokens", "ids_crc32"],
                )

    files = manifest.select("uri", "start")
    return files.repartition(shuffle_partitions(manifest.sparkSession)).mapInArrow(read, "key long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ids of the given keys: (key, ids), a row per record; a key that no file has, and null, gives none."""
    tables = manifest.inputFiles()

    def fetch(batches):
        if not tables:
            return
        fs = pafs.FileSystem.from_uri(tables[0])[0]
        m = pads.dataset([pafs.FileSystem.from_uri(t)[1] for t in tables], format="parquet", filesystem=fs).to_table(columns=["bucket", "seq", "uri", "min_key", "max_key"])
        m = m.filter(m["min_key"].is_valid()).sort_by([("bucket", "ascending"), ("seq", "ascending")])
        lows, highs, uris = m["min_key"].to_numpy(), m["max_key"].to_numpy(), m["uri"]
        at, shard = -1, None
        for batch in batches:
            wanted = np.sort(batch["key"].to_numpy())
            first, last = np.searchsorted(highs, wanted), np.searchsorted(lows, wanted, side="right")
            rows = sorted((f, k) for k, lo, hi in zip(wanted.tolist(), first.tolist(), last.tolist()) for f in range(lo, hi))
            found = []
            for f, k in rows:
                if f != at:
                    at, shard = f, idfile.Remote(uris[f].as_py())
                found += [(k, ids.astype(np.int64)) for ids in shard.get(k)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([ids for _, ids in found], pa.list_(pa.int64()))], names=["key", "ids"])

    wanted = keys.select(F.col(key).cast("long").alias("key")).where("key is not null").distinct()
    wanted = wanted.repartitionByRange(shuffle_partitions(manifest.sparkSession), "key").sortWithinPartitions("key")
    return wanted.mapInArrow(fetch, "key long, ids array<long>")


def query(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return read_ids(write_ids(docs, public_tokenizers.path("word_bpe_49k.json"))).withColumnRenamed("key", "doc_id")
