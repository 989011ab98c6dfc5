"""Ranked lexical search the other way round: the items' terms are the index, documents stream through it.

The items (a set of queries) are turned into an inverted index: term, and the items that hold it with how often. The index is
broadcast in slices of about SLICE_POSTINGS postings, so its size has a bound however many items there are: usually one
slice does; each further one takes another pass over the documents. A slice takes two steps:

1. Each document is tokenized once; how often it holds each term of the slice, and its length, are written as a table. The
   statistics (documents, terms in all, documents that hold a term) are sums over that table, so they cover all documents.
2. The table's rows go through the broadcast index in blocks: scores of a block of documents for all items of the slice are added up
   in 64-bit integers, and the best of a block go into a heap of k per item. Heaps of all tasks are merged by item, first some at a time.

A term's weight w is floor(1000 ln((2 N + 2) / (2 df + 1))); a document of n terms has m = 25 + (75 n N) div L, and the score sums
w * ((10^9 tf) div (1000 tf + 8 m)) over the item's terms, repeats included. Terms are runs of ASCII letters (A-Z as lower case), digits and
characters beyond ASCII. Equal scores go by doc_id, null first. Scores of 0 find nothing.

Rows with one item_id (null is one too) are one item, whose terms count as often as they occur in all its rows. Null and empty texts have
no terms: such items find nothing, such documents count nowhere. Repeated documents are documents of their own. A very long text is an item or
a document of many terms like any other; terms over LONG bytes stand in the index by their SHA-256. One item is in one slice, however long it is.
Extra columns are left aside. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import table, written

TOP_K = 10
SLICE_POSTINGS = 1_000_000
BLOCK_CELLS, BLOCK_POSTINGS = 2_000_000, 2_000_000
MERGE_PARTS = 64
LONG = 64
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def name_of(term: bytes) -> bytes:
    """What stands for a term in the index."""
    return term if len(term) <= LONG else b"\0" + hashlib.sha256(term).digest()


def _raw(texts: pa.Array):
    for t in texts:
        yield t.as_buffer().to_pybytes() if t.is_valid else b""


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term (binary), times, from rows (item_id, text)."""

    def split(batches):
        for batch in batches:
            for lo in range(batch.num_rows):
                [raw] = _raw(batch.column(1).slice(lo, 1))
                found = Counter(map(name_of, terms_of(raw)))
                ids = batch.column(0).slice(lo, 1).take(pa.array([0] * len(found), pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["item_id", "term", "times"])

    rows = items.select("item_id", F.col("text").cast("string").alias("text"))
    schema = StructType([rows.schema["item_id"]]).add("term", "binary").add("times", LongType())
    return rows.mapInArrow(split, schema).groupBy("item_id", "term").agg(F.sum("times").alias("times"))


class Index:
    """Postings by term: which items hold it, and how often; of at most about SLICE_POSTINGS postings."""

    def __init__(self, rows: pa.Table):
        ids = rows["item_id"].combine_chunks()
        self.items = ids.unique()
        item = pa.compute.index_in(ids, self.items).to_numpy()
        terms = rows["term"].to_pylist()
        self.number = {t: i for i, t in enumerate(dict.fromkeys(terms))}
        term = np.fromiter(map(self.number.__getitem__, terms), np.int64, len(terms))
        order = np.argsort(term, kind="stable")
        self.item, self.times = item[order].astype(np.int64), rows["times"].to_numpy()[order]
        self.off = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(self.number)))])
        self.long = any(t[0] == 0 for t in self.number)
        self.weight = np.zeros(len(self.number), np.int64)

    def weigh(self, df: dict[int, int], n_docs: int) -> None:
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(self.number))], np.int64)

    def counts(self, text: bytes) -> tuple[int, dict[int, int]]:
        """How many terms a text has, and how often it holds each numbered one."""
        words = terms_of(text)
        found = Counter(map(self.number.get, map(name_of, words) if self.long else words))
        found.pop(None, None)
        return len(words), found

    def add(self, into: np.ndarray, row: np.ndarray, term: np.ndarray, part: np.ndarray) -> None:
        """Adds the contributions of terms in rows (documents) to into[row, item]."""
        n = self.off[term + 1] - self.off[term]
        pos = np.arange(n.sum()) + np.repeat(self.off[term] - np.cumsum(n) + n, n)
        np.add.at(into.reshape(-1), np.repeat(row * into.shape[1], n) + self.item[pos], np.repeat(self.weight[term] * part, n) * self.times[pos])


class Heaps:
    """The k best documents of each item: (score, id is null, -id), least first."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)  # scores that may still get in

    def update(self, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        """scores: documents by items."""
        best = np.partition(scores, max(0, len(scores) - self.k), axis=0)[max(0, len(scores) - self.k)]
        least = np.maximum(self.least, best)
        for i in np.flatnonzero(scores.max(0) >= least):
            at = np.flatnonzero(scores[:, i] >= least[i])
            at = at[np.lexsort((ids[at], known[at], -scores[at, i]))[: self.k]]
            heap = self.heaps[i]
            for entry in zip(scores[at, i].tolist(), (~known[at]).tolist(), (-ids[at]).tolist()):
                if len(heap) < self.k:
                    heapq.heappush(heap, entry)
                else:
                    heapq.heappushpop(heap, entry)
            if len(heap) == self.k:
                self.least[i] = heap[0][0]

    def rows(self, items: pa.Array) -> pa.RecordBatch:
        flat = [(i, s, None if null else -d) for i, heap in enumerate(self.heaps) for s, null, d in heap]
        columns = [items.take(pa.array([x[0] for x in flat], pa.int64())), pa.array([x[2] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["item_id", "doc_id", "score"])


def term_counts(docs: DataFrame, index) -> DataFrame:
    """doc_id, n and, side by side, numbers of the index's terms in the document and how often they occur. Documents without terms are left out."""

    def count(batches):
        names = ["doc_id", "n", "terms", "tf"]
        for batch in batches:
            for lo in range(0, batch.num_rows, 1_000):
                some = batch.slice(lo, 1_000)
                got = [index.value.counts(raw) for raw in _raw(some.column(1))]
                full = [i for i, (n, _) in enumerate(got) if n]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(got[i][1]) for i in full])]), pa.int32())
                terms = pa.array([t for i in full for t in got[i][1]], pa.int32())
                tf = pa.array([c for i in full for c in got[i][1].values()], pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, terms), pa.ListArray.from_arrays(offsets, tf)]
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(full, pa.int32())), pa.array([got[i][0] for i in full], pa.int64()), *lists], names=names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, tf array<int>")


def best_of_tasks(counts: DataFrame, index, items: StructType, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item_id, doc_id, score: the k best documents of each item among the rows of each task."""

    def stream(batches):
        held = index.value
        heaps, rows = Heaps(len(held.items), k), max(1, BLOCK_CELLS // max(1, len(held.items)))
        for batch in batches:
            ids, known = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            m = np.array([25 + 75 * n * n_docs // n_terms for n in batch.column(1).to_pylist()], np.int64)
            off = batch.column(2).offsets.to_numpy().astype(np.int64)
            term, tf = (batch.column(c).values.to_numpy().astype(np.int64) for c in (2, 3))
            row = np.repeat(np.arange(batch.num_rows), np.diff(off))
            term, tf = term[off[0] : off[-1]], tf[off[0] : off[-1]]
            part = 1_000_000_000 * tf // (1000 * tf + 8 * m[row])
            postings = held.off[term + 1] - held.off[term]
            for lo in range(0, batch.num_rows, rows):
                scores = np.zeros((min(rows, batch.num_rows - lo), len(held.items)), np.int64)
                a, b = np.searchsorted(row, (lo, lo + len(scores)))
                cuts = np.flatnonzero(np.diff(np.cumsum(postings[a:b]) // BLOCK_POSTINGS)) + 1 + a
                for x, y in zip([a, *cuts], [*cuts, b]):
                    held.add(scores, row[x:y] - lo, term[x:y], part[x:y])
                heaps.update(scores, ids[lo : lo + len(scores)], known[lo : lo + len(scores)])
        yield heaps.rows(held.items)

    return counts.mapInArrow(stream, StructType([items["item_id"]]).add("doc_id", LongType()).add("score", LongType()))


def merged(best: DataFrame, k: int) -> DataFrame:
    """Heaps of many tasks to one ranking an item: the heaps of an item meet MERGE_PARTS-wise first."""
    order = (F.desc("score"), F.asc_nulls_first("doc_id"))
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(MERGE_PARTS))
    some = best.withColumn("_part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "_part").orderBy(*order))).where(F.col("rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def search(items: DataFrame, docs: DataFrame, k: int = TOP_K, slice_postings: int = SLICE_POSTINGS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) of each item (item_id, text)."""
    spark = docs.sparkSession
    terms = written(item_terms(items), "reversed-items")
    slices = max(1, -(-terms.count() // slice_postings))
    terms = terms.withColumn("slice", F.pmod(F.xxhash64("item_id"), F.lit(slices)))
    out = None
    for s in range(slices):
        index = Index(terms.where(F.col("slice") == s).drop("slice").toArrow())
        bare = spark.sparkContext.broadcast(index)
        counts = written(term_counts(docs, bare), "reversed-counts")
        n_docs, n_terms = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()  # a row per term of the slice at most
        index.weigh({r["term"]: r["df"] for r in df}, n_docs)
        part = best_of_tasks(counts, spark.sparkContext.broadcast(index), items.schema, n_docs, n_terms, k)
        out = part if out is None else out.unionByName(part)
    return merged(out, k)


def query(spark, sf_dir):
    return search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents
), tf AS (SELECT rid, any_value(doc_id) AS doc_id, any_value(len(ws)) AS n, w, count(*) AS tf FROM (SELECT *, unnest(ws) AS w FROM d) GROUP BY rid, w),
g AS (SELECT count(*) FILTER (len(ws) > 0) AS docs, CAST(sum(len(ws)) AS BIGINT) AS terms FROM d),
i AS (
  SELECT item_id, w, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS w FROM benchmark) GROUP BY ALL
), idf AS (SELECT w, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, g GROUP BY w, docs),
s AS (
  SELECT item_id, rid, any_value(doc_id) AS doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM i JOIN tf USING (w) JOIN idf USING (w), g GROUP BY item_id, rid
), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""
