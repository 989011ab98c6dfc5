"""SimHash near-duplicates: majority fingerprints and a tiled exact comparison.

Equal fingerprints fall together first, so copies cost one row. Distinct fingerprints are put in
cells by the population counts of their four 16-bit parts; the parts' count differences sum to a
lower bound of the Hamming distance, so only cells within the radius are compared. A cell with many
fingerprints is cut by hash into tiles of about TILE. Pairs of tiles are listed by number and spread
over the tasks before each gets its two tiles by number, so a dense cell's pairs don't meet in one task. A pair
of tiles is compared in numpy: exclusive or, bit counts. Of the links found in a pair of tiles a spanning forest is kept (their components are
the same, and a large group of near copies yields rows in proportion to its size).

Null and empty texts have fingerprint 0 and link like any other; a very long text's shingles are hashed some at a time; null
doc_ids are carried, and give a component its id only where it has no other (a component of null ids alone has null);
repeated rows are returned each; extra columns are left aside. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import product
from math import isqrt, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, table, trim, written
from .components import components

WORDS, RADIUS, SEED = 3, 2, 42
TILE = 2048
PARTS = 4


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Unsigned 64-bit SimHash of word shingles, repeats included; no words: 0."""
    import xxhash

    split = (text or "").encode().lower().split()  # bytes: lower-cases A-Z, splits at ASCII white space
    if not split:
        return 0
    joined = b" ".join(split)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split))) + np.arange(len(split))
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(split) - words + 1)
    last = np.minimum(np.arange(n) + words - 1, len(split) - 1)
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    lo, hi = starts[:n].tolist(), ends[last].tolist()
    for at in range(0, n, 65536):
        raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(lo[at : at + 65536], hi[at : at + 65536])])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs' columns with fp (the fingerprint's bits as a long) in place of text."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn("fp", fp(F.col("text").cast("string"))).drop("text")


def _offsets(radius: int) -> list[tuple[int, ...]]:
    """Differences of part counts within the radius, one of each opposite pair, zero first."""
    inside = [d for d in product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, d)) <= radius]
    return sorted(d for d in inside if d >= (0,) * PARTS)


def _forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links within the radius between two sets of fingerprints, thinned to a spanning forest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    out_a, out_b = [], []
    ua, ub = a.view(np.uint64), b.view(np.uint64)
    step = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(ua[at : at + step, None] ^ ub[None, :]) <= radius)
        for x, y in zip(a[at + i].tolist(), b[j].tolist()):
            if x != y and (p := root(x)) != (q := root(y)):
                parent[p] = q
                out_a.append(x)
                out_b.append(y)
    return out_a, out_b


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct fingerprints within the radius."""
    part = 64 // PARTS
    cell = sum((F.bit_count(F.shiftrightunsigned("fp", p * part).bitwiseAND(2**part - 1)) * (part + 1) ** p for p in range(PARTS)), F.lit(0))
    rows = distinct.select("fp", cell.cast("int").alias("cell"))
    # at most (part + 1) ** PARTS rows: 83,521
    sizes = written(rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("cuts")), "simhash-cells")
    tiles = rows.join(F.broadcast(sizes), "cell").withColumn("cut", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int"))
    tiles = written(tiles.groupBy("cell", "cut").agg(F.collect_list("fp").alias("fps")), "simhash-tiles")
    offsets = F.array(*[F.lit(sum(d[p] * (part + 1) ** p for p in range(PARTS))) for d in _offsets(radius)])
    # a carry between parts would name a cell whose counts differ by more: its pairs are compared too, and fail
    near = sizes.select(F.col("cell").alias("cell_a"), F.col("cuts").alias("cuts_a"), F.explode(offsets).alias("d")).withColumn("cell_b", F.col("cell_a") + F.col("d"))
    near = near.join(F.broadcast(sizes.select(F.col("cell").alias("cell_b"), F.col("cuts").alias("cuts_b"))), "cell_b")
    # a large cell has many tiles: its pairs of cells are dealt out before they list the first tile, and again before they list the second
    near = near.repartition("cell_a", "cell_b")
    pairs = near.select("cell_a", "cell_b", "cuts_b", F.explode(F.sequence(F.lit(0), F.col("cuts_a") - 1)).alias("cut_a")).repartition("cell_a", "cell_b", "cut_a")
    first = F.when(F.col("cell_a") == F.col("cell_b"), F.col("cut_a")).otherwise(0)
    pairs = pairs.select("cell_a", "cell_b", "cut_a", F.explode(F.sequence(first, F.col("cuts_b") - 1)).alias("cut_b"))
    left, right = (tiles.select(F.col("cell").alias(f"cell_{s}"), F.col("cut").alias(f"cut_{s}"), F.col("fps").alias(f"fps_{s}")) for s in "ab")
    pairs = pairs.join(left, ["cell_a", "cut_a"]).join(right, ["cell_b", "cut_b"])

    def compare(batches):
        for pdf in batches:
            a, b = [], []
            for left, right in zip(pdf["fps_a"], pdf["fps_b"]):
                x, y = _forest(np.asarray(left, np.int64), np.asarray(right, np.int64), radius)
                a += x
                b += y
            yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return pairs.select("fps_a", "fps_b").mapInPandas(compare, "a long, b long")


def _roots(rows: DataFrame, radius: int) -> DataFrame:
    """(fp, root) for each distinct fp of rows; root stands for its component."""
    groups = rows.select("fp").distinct()
    roots = components(written(links(groups, radius), "simhash-links"), "simhash-edges")
    return groups.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


_ODD = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def majority(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """The bits that are set in over half of 64-bit hashes, and in over half of what further functions make of these: `lanes` numbers of 64 bits, four at most."""
    ones = np.zeros(64 * lanes, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part, out = hashes[at : at + (1 << 14)], []
        for k in range(lanes):
            out.append(part if k == 0 else (part ^ (part >> np.uint64(32))) * _ODD[k])
            out[k] = out[k] if k == 0 else (out[k] ^ (out[k] >> np.uint64(29))) * _ODD[0]
        bits = np.unpackbits(np.stack(out, 1).astype(">u8").view(np.uint8), axis=1)
        for lo in range(0, len(bits), 255):
            ones += bits[lo : lo + 255].sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).view(">u8").astype(np.uint64)


def _wide_forest(left: dict[str, np.ndarray], right: dict[str, np.ndarray], same: bool, radius: int, first: int, ratio: float) -> tuple[list[int], list[int]]:
    """Links of two tiles of wide fingerprints (of one, if it is the same), thinned to a spanning forest."""
    lanes = [k for k in left if k.startswith("f")]
    by_size = [np.argsort(side["size"], kind="stable") for side in (left, right)]
    left, right = ({k: v[by] for k, v in side.items()} for side, by in zip((left, right), by_size))
    label = np.arange(len(by_size[0]) + (0 if same else len(by_size[1])))
    mine, theirs = label[: len(by_size[0])], label if same else label[len(by_size[0]) :]
    lo = np.searchsorted(right["size"], left["size"] * ratio - 1e-6)
    hi = np.searchsorted(right["size"], left["size"] / ratio + 1e-6, "right")
    a, b = [], []
    for i, (x, y) in enumerate(zip(lo.tolist(), hi.tolist())):
        at = x + np.flatnonzero(np.bitwise_count(right["f0"][x:y] ^ left["f0"][i]) <= first)
        at = at[theirs[at] != mine[i]]
        if len(at):
            at = at[sum(np.bitwise_count(right[k][at] ^ left[k][i]).astype(np.int64) for k in lanes) <= radius]
        while len(at):
            a.append(int(left["node"][i]))
            b.append(int(right["node"][at[0]]))
            label[label == theirs[at[0]]] = mine[i]
            at = at[theirs[at] != mine[i]]
    return a, b


def wide_links(rows: DataFrame, lanes: int, radius: int, first: int, ratio: float) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of rows (node, size, f0, f1, ...) within the radius.

    The fingerprints' numbers f0, f1, ... differ in `radius` bits or fewer, f0 in `first` or fewer, and of the sizes
    (of the sets of shingles) the less is `ratio` of the greater or more, so only tiles of like sizes are compared. A tile grows with the
    square root of the rows, so what tiles' pairs carry grows less than the pairs do.
    """
    tile = min(8 * TILE, max(TILE, isqrt(8 * rows.count())))
    rows = rows.withColumn("cell", F.floor(F.log("size") / (-log(ratio) * (1 + 1e-9))).cast("int"))
    # a row for each doubling of sizes or a few more
    sizes = written(rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("cuts")), "simhash-cells")
    dealt = rows.join(F.broadcast(sizes), "cell").withColumn("cut", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
    names = ["node", "size", *[f"f{k}" for k in range(lanes)]]
    tiles = written(dealt.groupBy("cell", "cut").agg(F.collect_list(F.struct(*names)).alias("rows")), "simhash-tiles", 4)
    near = sizes.select(F.col("cell").alias("cell_a"), F.col("cuts").alias("cuts_a"), F.explode(F.array(F.lit(0), F.lit(1))).alias("d")).withColumn("cell_b", F.col("cell_a") + F.col("d"))
    near = near.join(F.broadcast(sizes.select(F.col("cell").alias("cell_b"), F.col("cuts").alias("cuts_b"))), "cell_b")
    pairs = near.select("cell_a", "cell_b", "cuts_b", F.explode(F.sequence(F.lit(0), F.col("cuts_a") - 1)).alias("cut_a")).repartition("cell_a", "cell_b", "cut_a")
    same = F.col("cell_a") == F.col("cell_b")
    pairs = pairs.select("cell_a", "cell_b", "cut_a", F.explode(F.sequence(F.when(same, F.col("cut_a")).otherwise(0), F.col("cuts_b") - 1)).alias("cut_b"))
    left, right = (tiles.select(F.col("cell").alias(f"cell_{s}"), F.col("cut").alias(f"cut_{s}"), F.col("rows").alias(f"rows_{s}")) for s in "ab")
    pairs = pairs.join(left, ["cell_a", "cut_a"]).join(right, ["cell_b", "cut_b"])
    # the pairs of a large cell are spread once more: comparing is what takes time
    pairs = pairs.select("rows_a", "rows_b", (same & (F.col("cut_a") == F.col("cut_b"))).alias("same")).repartition(shuffle_partitions(rows.sparkSession))

    def compare(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                tiles = []
                for s in "ab":
                    column = dict(zip(names, batch.column(f"rows_{s}")[at].values.flatten()))
                    tiles.append({k: v.to_numpy() if k in ("node", "size") else v.to_numpy().view(np.uint64) for k, v in column.items()})
                a, b = _wide_forest(*tiles, batch.column("same")[at].as_py(), radius, first, ratio)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        trim()

    return pairs.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id for each row of docs."""
    rows = written(fingerprints(docs.select(F.col("doc_id").cast("long"), "text"), words), "simhash-rows")
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = least.join(_roots(rows, radius), "fp")
    component = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(component, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def one_per_component(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """Of each component the row with the smallest doc_id (nulls last; of repeated rows the first read)."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    named = docs.select(whole.alias("doc"), F.col("doc_id").cast("long").alias("id"), "text", F.monotonically_increasing_id().alias("rid"))
    rows = written(fingerprints(named, words), "simhash-documents")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "rid"))
    by_fp = rows.groupBy("fp").agg(first.alias("first")).join(_roots(rows, radius), "fp")
    kept = by_fp.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.rid").alias("rid"))
    return rows.join(kept, "rid", "left_semi").select("doc.*")


def query(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
