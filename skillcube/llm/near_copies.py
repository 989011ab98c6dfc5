"""Near copies by SimHash over word shingles: fingerprints name groups, exact sets confirm them.

Texts with the same set of shingles fall together first, so copies cost one row. Each set gets a fingerprint of
LANES numbers of 64 bits, the majority of its shingles' hashes (op3_simhash, whose tiles are here of sets of like size). Sets of similarity s
differ in a bit with probability acos(2 s / (1 + s)) / pi or a little more; pairs within a radius that leaves room for
chance are candidates, and a candidate is a link only if the exact Jaccard similarity of its sets is LEAST or more. At 0.8 the
radius of 74 of 256 bits is six standard deviations off for large sets, four for the smallest (four shingles of five).

A group's sets (a component of candidates) are first compared with one of them, so that a large group of near copies yields pairs in
proportion to its size. Then, in each group whose sets are not yet in one component, all pairs of sets of
different components are compared, in pairs of tiles; so each candidate is linked through others or compared.

Texts move only where Spark's own check of sizes finds the ids to pick or drop too many to be sent to all tasks.

Null and empty texts have the empty set and are copies of each other; a text of fewer than WORDS words has
one shingle, all of it. A very long text is a large set, compared in a tile of its own. Repeated rows count as copies. Extra
columns are carried as they are, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import op3_simhash
from .common import trim, written
from .components import components

WORDS, LEAST, SEED = 5, 0.8, 42
LANES = 4
#: Pairs that share an end are dealt out in groups of about this many.
FAN = 500
#: Rows of an Arrow batch, where a row holds a text or two sets.
BATCH = 500
#: A tile has about so many sets, and so many shingles, at most (a longer set has a tile of its own); COLUMNS shingles at a time are counted.
TILE, TILE_SHINGLES, COLUMNS = 256, 1 << 17, 4096


def radius(least: float, bits: int) -> int:
    """Bits that fingerprints of sets of similarity `least` differ in at most: a quarter above the mean, for small sets, and four standard deviations."""
    p = 1.25 * acos(2 * least / (1 + least)) / pi
    return ceil(bits * p + 4 * sqrt(bits * p * (1 - p)))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; no words: none."""
    import xxhash

    split = (text or "").encode().lower().split()  # bytes: lower-cases A-Z, splits at ASCII white space
    if not split:
        return np.zeros(0, np.uint64)
    joined = b" ".join(split)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split))) + np.arange(len(split))
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(split) - words + 1)
    last = np.minimum(np.arange(n) + words - 1, len(split) - 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[last].tolist())), np.uint64, n))


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have Jaccard similarity least or more."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small):
        return not len(large)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return both >= least * (len(a) + len(b) - both) - 1e-9


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of two lists of sets."""
    a, b = np.concatenate(left), np.concatenate(right)
    row_a, row_b = (np.repeat(np.arange(len(x)), [len(h) for h in x]) for x in (left, right))
    both = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, len(both), COLUMNS):
        part = both[lo : lo + COLUMNS]
        grids = []
        for h, row, n in ((a, row_a, len(left)), (b, row_b, len(right))):
            at = np.minimum(np.searchsorted(part, h), len(part) - 1)
            inside = part[at] == h
            grid = np.zeros((n, len(part)), np.float32)
            grid[row[inside], at[inside]] = 1
            grids.append(grid)
        out += grids[0] @ grids[1].T
    return out


def _tile_links(left: list[np.ndarray], right: list[np.ndarray], roots_a: list[int], roots_b: list[int], least: float) -> list[tuple[int, int]]:
    """Pairs of different components that the similar sets of two tiles link, thinned to a spanning forest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    both = _shared(left, right)
    sizes = np.array([len(h) for h in left])[:, None] + np.array([len(h) for h in right])[None, :]
    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(both >= least * (sizes - both) - 1e-6))):
        if (p := root(roots_a[i])) != (q := root(roots_b[j])):
            parent[p] = q
            out.append((roots_a[i], roots_b[j]))
    return out


def _set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u8")


def fingerprinted(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs' columns with node (a hash of the shingle set), size (of the set) and fingerprint f0, f1, ... in place of text."""

    lanes = [f"f{k}" for k in range(LANES)]

    @F.arrow_udf(", ".join(["node long", "size long", *[f"{f} long" for f in lanes]]))
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import xxhash

        for texts in batches:
            node, size, bits = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.int64), np.zeros((LANES, len(texts)), np.uint64)
            for i, t in enumerate(texts):  # one text at a time becomes a Python string
                h = shingles(t.as_py(), words)
                node[i], size[i] = xxhash.xxh64_intdigest(h.astype("<u8").tobytes(), SEED), len(h)
                bits[:, i] = op3_simhash.majority(h, LANES)
            yield pa.StructArray.from_arrays([pa.array(node.view(np.int64)), pa.array(size), *[pa.array(row.view(np.int64)) for row in bits]], ["node", "size", *lanes])
        trim()

    names = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(*names, of(F.col("text").cast("string")).alias("_k")).select(*names, "_k.*")


def _star_links(shared: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between the sets under a key and one of them."""
    pairs = shared.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    fans = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("cuts"))
    dealt = pairs.join(fans, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("cuts")).cast("int").alias("cut"))
    right = fans.join(sets.withColumnRenamed("node", "b"), "b").select("b", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), F.col("set").alias("right"))

    @F.arrow_udf("boolean")
    def alike(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            yield pa.array([similar(_set(x.as_py()), _set(y.as_py()), least) for x, y in zip(left, right)], pa.bool_())
        trim()

    met = dealt.join(sets.select(F.col("node").alias("a"), F.col("set").alias("left")), "a").join(right, ["b", "cut"])
    return met.where(alike("left", "right")).select("a", "b")


def _cross_links(shared: DataFrame, sets: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between roots, of similar sets that share a key and have different roots."""
    rows = shared.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    apart = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    rows = rows.join(apart, "key").join(sets, "node")
    size = F.sum(F.length("set") / 8)
    cuts = written(rows.groupBy("key").agg(F.ceil(F.greatest(F.count(F.lit(1)) / TILE, size / TILE_SHINGLES)).cast("int").alias("cuts")), "near-cuts")
    dealt = rows.join(cuts, "key").withColumn("cut", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
    tiles = written(dealt.groupBy("key", "cut").agg(F.collect_list("root").alias("roots"), F.collect_list("set").alias("sets")), "near-tiles")
    # pairs as numbers first: those of one key are dealt out by their first tile before they list the second and get their tiles
    pairs = cuts.select("key", "cuts", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("a")).repartition("key", "a")
    pairs = pairs.select("key", "a", F.explode(F.sequence("a", F.col("cuts") - 1)).alias("b"))
    left, right = (tiles.select("key", F.col("cut").alias(s), F.col("roots").alias(f"roots_{s}"), F.col("sets").alias(f"sets_{s}")) for s in "ab")
    pairs = pairs.join(left, ["key", "a"]).join(right, ["key", "b"]).select(*[f"{c}_{s}" for s in "ab" for c in ("roots", "sets")])

    def compare(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pydict()
                left, right = ([_set(x) for x in r[f"sets_{s}"][0]] for s in "ab")
                found = _tile_links(left, right, r["roots_a"][0], r["roots_b"][0], least)
                if found:
                    yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})
        trim()

    return pairs.mapInArrow(compare, "a long, b long")


def _roots(rows: DataFrame, firsts: DataFrame, words: int, least: float) -> DataFrame:
    """(node, root) of the nodes that are linked to another."""
    found = op3_simhash.wide_links(firsts.where("size > 0").select("node", "size", *[f"f{k}" for k in range(LANES)]), LANES, radius(least, 64 * LANES), radius(least, 64), least)
    groups = components(written(found, "near-candidates"), "near-edges")
    shared = written(groups.select(F.col("root").alias("key"), "node", F.col("root").alias("least")), "near-shared")

    @F.arrow_udf("binary")
    def packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array((shingles(t.as_py(), words).astype("<u8").tobytes() for t in texts), pa.binary())
        trim()

    one = written(firsts.join(shared.select("node").distinct(), "node", "left_semi").select(F.col("first.rid").alias("rid")), "near-picked")
    sets = written(rows.join(one, "rid", "left_semi").select("node", packed(F.col("doc.text").cast("string")).alias("set")), "near-sets", BATCH)
    star = components(written(_star_links(shared, sets, least), "near-links", BATCH), "near-edges")
    star = written(star, "near-roots")
    cross = written(_cross_links(shared, sets, star, least), "near-links", 4)
    joined = components(cross, "near-edges").select(F.col("node").alias("root"), F.col("root").alias("further"))
    both = star.join(joined, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
    # a set without a link in its star is its own root
    return both.union(joined.join(star.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("further").alias("root")))


def one_per_group(docs: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """Of each group of linked texts the row with the smallest doc_id (nulls last; of repeated rows the first read)."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    named = docs.select(whole.alias("doc"), F.col("doc_id").cast("long").alias("id"), "text", F.monotonically_increasing_id().alias("rid"))
    rows = written(fingerprinted(named, words), "near-documents", BATCH)
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "rid"))
    same = [F.any_value(c).alias(c) for c in ("size", *[f"f{k}" for k in range(LANES)])]  # one set's
    firsts = written(rows.groupBy("node").agg(first.alias("first"), *same), "near-firsts")
    by_node = firsts.join(_roots(rows, firsts, words, least), "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    kept = by_node.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.rid").alias("rid"))
    dropped = written(rows.select("rid").join(kept, "rid", "left_anti"), "near-dropped")  # fewer than those kept, as a rule
    return rows.join(dropped, "rid", "left_anti").select("doc.*")
