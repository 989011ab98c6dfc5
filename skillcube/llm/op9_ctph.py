"""Context-triggered piecewise hashing of texts, and likeness of fingerprints by edit distance.

A rolling hash over the last WINDOW bytes ends a chunk wherever it meets a trigger value for the block
size, and a chunk without one ends after LONGEST block sizes; each chunk gives one character of the signature.
The block size is the smallest BLOCK_MIN * 2**k that would cut the text into at most SIGNATURE chunks, doubled while it
gives more than twice as many and halved while it gives under a quarter of them, so that a signature has
at most 2 * SIGNATURE characters whatever the text; a second signature at twice the size lets
fingerprints of neighbouring block sizes be compared. Likeness: of the signatures at a block size both
have, 1 - (insertions + deletions) / (both lengths), if they share a run of COMMON characters (or are
that short and equal in part: see `likeness`), else 0; equal fingerprints have likeness 1.

Null texts are empty: their fingerprint has empty signatures, which equal each other only. Texts of few distinct windows (one
word repeated) have few triggers and are cut by length. Very long texts are hashed in pieces of PIECE_BYTES. Documents
are put in order of descending id (nulls last, equal ids by a hash of the text) by ranges, with the first
document of a range sent to the one before as well, so texts move once. Equal rows are each other's next; rows equal in id and text
stay in one range, which streams them, so many of them make a task longer but hold no more memory. Extra columns are left
aside. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import range_bounds, shuffle_partitions, slices, table, with_range

WINDOW, BLOCK_MIN, SIGNATURE, COMMON, LONGEST = 7, 3, 64, 5, 4
PIECE_BYTES = 1 << 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def _rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the last WINDOW bytes at each position (zeros before the start), in uint32."""
    n = len(data)
    out = np.zeros(n, np.uint32)
    for back in range(min(WINDOW, n)):
        weight = np.uint32((0x9E3779B1 * (2 * back + 3) ** 3) & 0xFFFFFFFF)
        out[back:] += data[: n - back] * weight
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x85EBCA6B)
    return out ^ (out >> np.uint32(13))


def _triggers(raw: bytes, size: int) -> np.ndarray:
    """Ends of chunks (after the triggering byte) at a block size; those at twice the size are among them."""
    found = []
    for lo in range(0, len(raw), PIECE_BYTES):
        start = max(0, lo - WINDOW + 1)
        data = np.frombuffer(raw, np.uint8, min(len(raw), lo + PIECE_BYTES) - start, start).astype(np.uint32)
        h = _rolling(data)[lo - start :]
        found.append(np.flatnonzero(h % np.uint32(size) == size - 1) + lo + 1)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _ends(raw: bytes, size: int) -> np.ndarray:
    """Ends of all chunks at a block size, the last one at the end of the text."""
    found = _triggers(raw, size)
    ends = found if len(found) and found[-1] == len(raw) else np.append(found, len(raw))
    starts = np.append(0, ends[:-1])
    parts = (ends - starts + LONGEST * size - 1) // (LONGEST * size)
    if parts.max() == 1:
        return ends
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.minimum(np.repeat(starts, parts) + (nth + 1) * LONGEST * size, np.repeat(ends, parts))


def _signature(raw: bytes, ends: list[int]) -> str:
    out, at = [], 0
    for end in ends:
        out.append(ALPHABET[(zlib.crc32(raw[at:end]) * 0x9E3779B1 >> 20) & 63])
        at = end
    return "".join(out)


def fingerprint(text: str) -> str:
    """blocksize:signature:signature at twice the block size."""
    raw = text.encode()
    if not raw:
        return f"{BLOCK_MIN}::"
    size = BLOCK_MIN
    while size * SIGNATURE < len(raw):
        size *= 2
    ends = _ends(raw, size)
    while len(ends) > 2 * SIGNATURE:
        size *= 2
        ends = _ends(raw, size)
    while len(ends) < SIGNATURE // 4 and size > BLOCK_MIN:
        finer = _ends(raw, size // 2)
        if len(finer) > 2 * SIGNATURE:
            break
        size, ends = size // 2, finer
    return f"{size}:{_signature(raw, ends.tolist())}:{_signature(raw, _ends(raw, 2 * size).tolist())}"


def _shared(a: str, b: str) -> int:
    """Length of the longest common subsequence, a machine word of `b` at a time."""
    masks: dict[str, int] = {}
    for i, c in enumerate(b):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for c in a:
        if u := row & masks.get(c, 0):
            row = ((row + u) | (row - u)) & full
    return len(b) - row.bit_count()


def _alike(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    run = max(2, min(COMMON, len(a) // 3, len(b) // 3))
    runs = {a[i : i + run] for i in range(len(a) - run + 1)}
    if not any(b[i : i + run] in runs for i in range(len(b) - run + 1)):
        return 0.0
    return 2 * _shared(a, b) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1; block sizes further apart than a factor of two give 0."""
    if x == y:
        return 1.0
    (s, a1, a2), (t, b1, b2) = x.split(":"), y.split(":")
    s, t = int(s), int(t)
    if s == t:
        return max(_alike(a1, b1), _alike(a2, b2))
    if s == 2 * t:
        return _alike(a1, b2)
    return _alike(a2, b1) if t == 2 * s else 0.0


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def with_next(docs: DataFrame, buckets: int) -> tuple[DataFrame, int]:
    """Rows (bucket, own, doc_id, text, h): each range's rows, then the row that follows its last one; and the number of ranges."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # ascending keys for descending ids, nulls last
    keys = {"k": F.col("doc_id").isNull().cast("long"), "d": F.bitwise_not("doc_id"), "h": F.xxhash64("text")}
    rows = rows.withColumns(keys)
    bounds = range_bounds(rows, [*keys], buckets)
    if not bounds:
        return rows.withColumn("bucket", F.lit(0)).withColumn("own", F.lit(True)), 1
    n = len(bounds)
    rows = with_range(rows, [*keys], bounds)
    first = F.broadcast(docs.sparkSession.createDataFrame([(i, *b) for i, b in enumerate(bounds)], "hb int, hk long, hd long, hh long"))  # a row per range
    rows = rows.join(first, F.col("bucket") == F.col("hb"))
    leads = (F.col("k") == F.col("hk")) & F.col("d").eqNullSafe(F.col("hd")) & (F.col("h") == F.col("hh"))
    here = F.struct(F.col("bucket").alias("b"), F.lit(True).alias("own"))
    before = F.struct(F.pmod(F.col("bucket") - 1, F.lit(n)).alias("b"), F.lit(False).alias("own"))
    copies = F.when(leads, F.array(here, before)).otherwise(F.array(here))
    rows = rows.select("doc_id", "text", "h", F.explode(copies).alias("c"))
    return rows.select(F.col("c.b").alias("bucket"), F.col("c.own").alias("own"), "doc_id", "text", "h"), n


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row per document, as the registered query returns it."""
    rows, n = with_next(docs, shuffle_partitions(docs.sparkSession))
    rows = rows.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", F.desc("own"), F.desc_nulls_last("doc_id"), "h", "text")

    def run(batches):
        held, done = None, False  # the row that waits for its follower: (doc_id, text, fingerprint); rows after the first sentinel

        def row(doc, nxt):
            text, mine = doc[1], doc[2]
            e = edited(text, nxt[1])
            f = fingerprint(e)
            return doc[0], len(text), hashlib.sha256(e.encode()).hexdigest(), mine, f, likeness(mine, f), likeness(mine, nxt[2])

        bucket = None
        for batch in slices(batches, 200):
            out = []
            for b, own, k, raw in zip(*(batch[c].to_pylist() for c in ("bucket", "own", "doc_id")), batch["text"]):
                if b != bucket:
                    bucket, held, done = b, None, False
                if done:
                    continue
                t = raw.as_py()
                now = (k, t, fingerprint(t))
                if held is not None:
                    out.append(row(held, now))
                held, done = now, not own
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), OUT)], schema=OUT)

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))
