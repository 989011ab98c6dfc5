"""Deterministic sharded WARC writer and its reader.

Records go in order of page_id (equal ids in order of a hash of the html). Their places are fixed by the data alone: a shard is a
run of pages whose stored bytes, counted over all pages in order, fall in one window of shard_bytes (a SHARDS-th of all
bytes, between LEAST_SHARD and MOST_SHARD); within a shard
the writer rolls to a new file when the compressed size passes ROLL_BYTES. Headers, record ids and
digests are derived from the row, dates are fixed, and every record is a gzip member of its own, so
reruns give the same bytes under the same names.

Of pages with equal payloads of at least MIN_REVISIT_BYTES the one with the smallest page_id is a
response; the others are revisits that name it and store no payload. Payloads move through one shuffle.
A task writes files under temporary names of its attempt; the manifest that Spark commits says which
attempt counts; those files are then renamed, the final manifest is written, and the temporary folder goes last.

Null html is an empty payload. Null page_ids come first. Pages of one id that fill more than a shard are cut like others. Repeated rows
give a record each: of equal pages the first is the response. Line breaks in urls are percent-encoded. A very long page is a record
like any other, held by its task as a whole. Extra columns are left aside. An empty table gives no file.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import move, open_input, open_output, range_bounds, remove, scratch_dir, shuffle_partitions, table, with_range, written

MIN_REVISIT_BYTES = 100
SHARDS, LEAST_SHARD, MOST_SHARD = 1_000, 16 << 20, 1 << 30
ROLL_BYTES, RECORD_BYTES, READ_BYTES = 128 << 20, 600, 4 << 20
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # name space of URLs
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEYS = ["page_id", "h"]
MANIFEST = "shard long, seq int, temp string, final string, records long, bytes long, sha256 string"


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def record(page_id, url: str | None, payload: bytes, digest: str, n_bytes: int, refers_to) -> bytes:
    """One WARC record; refers_to: (page_id,) of the response for a revisit, else None. Revisits have no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if refers_to:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to[0], digest)}"]
        if refers_to[0] is not None:
            lines.append(f"Refers-To-Page-ID: {refers_to[0]}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes):
    """(headers, http headers, payload) of each record in decompressed WARC bytes; digests are checked."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        first, *lines = raw[at:end].decode().split("\r\n")
        if first != "WARC/1.1":
            raise ValueError("not a WARC record")
        head = dict(line.split(": ", 1) for line in lines)
        n = int(head["Content-Length"])
        block = raw[end + 4 : end + 4 + n]
        if len(block) != n or raw[end + 4 + n : end + 8 + n] != b"\r\n\r\n" or head["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise ValueError(f"damaged record {head['WARC-Record-ID']}")
        cut = block.index(b"\r\n\r\n") + 4
        http = dict(line.split(": ", 1) for line in block[: cut - 4].decode().split("\r\n")[1:])
        yield head, http, block[cut:]
        at = end + 8 + n


def members(stream, seen=lambda raw: None, step: int = 1 << 16):
    """Decompressed gzip members of a stream, one at a time; seen: gets the bytes as they are read. What is left of a step is all that is copied."""
    d, parts, begun = zlib.decompressobj(31), [], False
    while raw := stream.read(step):
        seen(raw)
        while raw:
            begun = True
            parts.append(d.decompress(raw))
            raw = d.unused_data
            if d.eof:
                yield b"".join(parts)
                d, parts, begun = zlib.decompressobj(31), [], False
    if begun:
        raise ValueError("the last record is cut off")


def _meta(pages: DataFrame) -> DataFrame:
    """Small columns: page_id, h, digest, n_bytes, refers (struct of the response's page_id, null for a first)."""
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    meta = written(pages.select("page_id", "h", F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("n_bytes")), "warc-meta")
    same = meta.where(F.col("n_bytes") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.col("page_id").isNotNull().alias("k"), "page_id")).alias("first"))
    same = same.where("copies > 1").select("digest", F.col("first.page_id").alias("first"), F.lit(True).alias("copied"))
    return meta.join(same, "digest", "left").withColumn("refers", F.coalesce(F.col("copied"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first")))


def _shards(meta: DataFrame, buckets: int) -> list[tuple]:
    """The first (page_id, h) of each shard, by running totals of stored bytes in order."""
    stored = meta.select("page_id", "h", (F.when(F.col("refers"), 0).otherwise(F.col("n_bytes")) + RECORD_BYTES).alias("bytes"))
    total = stored.agg(F.sum("bytes")).first()[0] or 0
    shard_bytes = min(MOST_SHARD, max(LEAST_SHARD, total // SHARDS))
    rows = written(with_range(stored, KEYS, range_bounds(stored, KEYS, buckets)), "warc-order")
    sums = rows.groupBy("bucket").agg(F.sum("bytes").alias("b"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = F.broadcast(sums.select("bucket", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("base")))  # a row per bucket
    within = F.sum("bytes").over(Window.partitionBy("bucket").orderBy(F.asc_nulls_first("page_id"), "h").rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.join(base, "bucket").withColumn("shard", F.floor((F.col("base") + F.coalesce(within, F.lit(0))) / shard_bytes).cast("long"))
    # a row per shard, 1 GB of archive at scale
    return [tuple(r["first"]) for r in placed.groupBy("shard").agg(F.min(F.struct(*KEYS)).alias("first")).orderBy("shard").collect()]


def write_warc(pages: DataFrame, roll_bytes: int = ROLL_BYTES) -> tuple[str, DataFrame]:
    """Writes the archives; returns their folder and the manifest (a row per file)."""
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).withColumn("h", F.xxhash64("html"))
    n, folder = shuffle_partitions(spark), scratch_dir(spark, "warc")
    meta = written(_meta(pages), "warc-types")
    cuts = _shards(meta, n)

    # what is known of copies comes before the page itself, in the page's shard
    copied = meta.where("copied").select("page_id", "h", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.col("digest").alias("html"), F.col("first").alias("first"), "refers").distinct()
    both = pages.select("page_id", "h", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("first"), F.lit(False).alias("refers")).unionByName(copied)
    shards = max(1, len(cuts))
    rows = with_range(both, KEYS, cuts, "shard").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_first("page_id"), "h", "kind", "html", "url")

    def write(batches):
        out, shard, seq, state = None, None, 0, {}
        known, key = {}, object()

        def close():
            nonlocal out
            out.close()
            row = [shard, seq, state["temp"], state["final"], state["records"], state["bytes"], state["sha"].hexdigest()]
            out = None
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, TYPES)], names=NAMES)

        for batch in batches:
            for s, page, kind, url, html, first, refers in zip(*(batch[c].to_pylist() for c in ("shard", "page_id", "kind", "url", "html", "first", "refers"))):
                if page != key:
                    known, key = {}, page
                if kind == 0:
                    known[html] = [(first,), refers]
                    continue
                if out is not None and (s != shard or state["bytes"] >= roll_bytes):
                    yield close()
                    seq = seq + 1 if s == shard else 0
                if out is None:
                    shard = s
                    name = f"{shard:08d}-{seq:05d}.warc.gz"
                    state = {"temp": f"{folder}/_temporary/{name}.{uuid.uuid4().hex}", "final": f"{folder}/{name}", "records": 0, "bytes": 0, "sha": hashlib.sha256()}
                    out = open_output(state["temp"])
                payload = (html or "").encode()
                digest = hashlib.sha256(payload).hexdigest()
                to = known.get(digest)
                raw = record(page, url, b"" if to and to[1] else payload, digest, len(payload), to[0] if to and to[1] else None)
                if to:
                    to[1] = True  # an equal row after the response is a revisit of it
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = z.compress(raw) + z.flush()
                out.write(raw)
                state["records"] += 1
                state["bytes"] += len(raw)
                state["sha"].update(raw)
        if out is not None:
            yield close()

    NAMES = [f.split()[0] for f in MANIFEST.split(", ")]
    TYPES = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    staged = written(rows.mapInArrow(write, MANIFEST), "warc-staged")

    def commit(batches):
        for pdf in batches:
            for a, b in zip(pdf["temp"], pdf["final"]):
                move(a, b)
            yield pdf

    manifest = staged.repartition(shards).mapInPandas(commit, MANIFEST).drop("temp").withColumnRenamed("final", "uri")
    path = f"{folder}/_manifest"
    manifest.write.parquet(path)
    remove(f"{folder}/_temporary")
    return folder, spark.read.schema(manifest.schema).parquet(path)


def read_warc(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """A row per record: page_id, url, record_type, payload_bytes, payload_digest, refers_to and, if asked for, payload (null for a revisit).

    Files are streamed: a task holds a record, and the rows of about READ_BYTES.
    """
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"][: 7 if payloads else 6]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def rows_of(uri: str, sha: str):
        digest_of_file = hashlib.sha256()
        with open_input(uri) as f:
            for member in members(f, digest_of_file.update):
                for head, http, payload in parse(member):
                    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
                    n = int(http["Content-Length"])
                    if kind == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"damaged payload in {uri}")
                    ids = [None if head.get(k) is None else int(head[k]) for k in ("Page-ID", "Refers-To-Page-ID")]
                    yield (ids[0], head.get("WARC-Target-URI"), kind, n, digest, ids[1], payload if kind == "response" else None)[: len(names)]
        if digest_of_file.hexdigest() != sha:
            raise ValueError(f"{uri} differs from its manifest")

    def read(batches):
        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for uri, sha in zip(batch["uri"].to_pylist(), batch["sha256"].to_pylist()):
                rows, held = [], 0
                for row in rows_of(uri, sha):
                    rows.append(row)
                    held += 500 + (len(row[6] or b"") if payloads else 0)
                    if held >= READ_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + (", payload binary" if payloads else "")
    return manifest.select("uri", "sha256").repartition(shuffle_partitions(manifest.sparkSession)).mapInArrow(read, schema)


def query(spark, sf_dir):
    _, manifest = write_warc(table(spark, sf_dir, "pages"))
    return read_warc(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM f
"""
