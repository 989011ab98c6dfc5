"""Exact top-k BM25 search: an inverted index per shard, block-max WAND pruning, an exact merge.

Index: each task turns its documents into shards of at most SHARD_POSTINGS postings and SHARD_DOCS
documents (a file each, named by the manifest): terms as 64-bit hashes, postings by term, lengths. Within
a shard documents with like frequent terms stand side by side, in blocks of BLOCK.
Global statistics (rows, mean length, document frequency of the terms) come from all shards.

Search: tasks take pairs of a shard and a slice of the query set, so neither a larger corpus nor a larger
query set makes a task longer. For each frequent term a shard keeps the largest contribution in each block;
a query's sums of these, for a batch of queries a product of matrices, are upper bounds of all blocks
at once. A rare term has about one posting in a block, which is its block's maximum. Blocks whose
bound is below the threshold (the k-th best score so far) of all queries of a batch are skipped: nothing of
them is read from the frequent terms' lists. A batch holds queries whose best blocks are near each other. The
documents of the other blocks are scored, once more a product of matrices, and those that reach the
threshold again in 64 bits.
The first shards are searched first, and the others start from the thresholds that these give; the
merge keeps the k best of all rows.

Scores are rounded to SCORE_DIGITS, ties go to the smaller doc_id (null first). Terms are runs of ASCII
letters (A-Z as lower case), digits and characters beyond ASCII; a query is the set of its terms, and
rows with one query_id (null is one too) are one query, so repeated query rows change nothing. Null and empty
texts have no terms: as queries they find nothing, as documents they count in the statistics. Repeated
documents are documents of their own. A very long text is a query or a document of many terms like any other. Extra
columns are left aside. An empty table gives no rows.
"""

from __future__ import annotations

import io
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import open_output, read_bytes, scratch_dir, shuffle_partitions, slices, table, written

K1, B, TOP_K, SCORE_DIGITS = 1.2, 0.75, 10, 4
SHARD_POSTINGS, SHARD_DOCS, BLOCK = 4_000_000, 1 << 15, 8
#: Terms in a FREQUENT-th of a shard's documents count as frequent, the DENSE most frequent ones at most.
DENSE, FREQUENT = 512, 64
ORDER_TERMS, ORDER_AXES, ORDER_SAMPLE = 128, 3, 2_048
QUERY_SLICE, QUERIES_READ, QUERY_BATCH = 2_048, 1_024, 64
ROUNDS = (1 / 16, 1.0)
QUERY_EVERY = 50
#: Bounds and first scores are sums in 32 bits: they are trusted to this share of the largest of them, and to SLACK.
SHARE, SLACK = 1e-4, 2 * 10.0**-SCORE_DIGITS
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


class TermIds:
    """64-bit hashes of terms; forgets at a bound."""

    LIMIT = 500_000

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct terms of a text and how often they occur."""
        import xxhash

        words = Counter((text or "").encode().translate(_TABLE).split())
        if len(self.known) > self.LIMIT:
            self.known.clear()
        for w in words:
            if w not in self.known:
                self.known[w] = xxhash.xxh64_intdigest(w)
        n = len(words)
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, n), np.fromiter(words.values(), np.uint32, n)


def _least_dtype(a: np.ndarray) -> np.ndarray:
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def _side_by_side(lens: np.ndarray, terms: list[np.ndarray]) -> np.ndarray:
    """An order of the documents by the signs of the main axes of some frequent terms, then by length."""
    names, df = np.unique(np.concatenate(terms[:: 1 + len(terms) // ORDER_SAMPLE]), return_counts=True)
    top = np.sort(names[np.argsort(-df, kind="stable")[:ORDER_TERMS]])
    x = np.zeros((len(terms), len(top)), np.float32)
    if not len(top):
        return np.arange(len(terms))
    for row, t in zip(x, terms):
        at = np.minimum(np.searchsorted(top, t), len(top) - 1)
        row[at[top[at] == t]] = 1
    x -= x.mean(0)
    _, axes = np.linalg.eigh(x.T @ x)
    side = (x @ axes[:, -ORDER_AXES:]) > 0
    return np.lexsort((lens, side @ (1 << np.arange(side.shape[1]))))


def pack_shard(doc_ids: list, lens: list, terms: list[np.ndarray], tfs: list[np.ndarray]) -> bytes:
    """A shard's file. terms, tfs: of each document, distinct terms and how often they occur."""
    lengths = np.array(lens, np.int64)
    order = _side_by_side(lengths, terms)
    all_ = np.concatenate([terms[i] for i in order])
    by_term = np.argsort(all_, kind="stable")
    all_ = all_[by_term]
    first = np.flatnonzero(np.concatenate([[True], all_[1:] != all_[:-1]])) if len(all_) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(order)), [len(terms[i]) for i in order])[by_term]
    tf = np.concatenate([tfs[i] for i in order])[by_term]
    ids, known = np.array([d or 0 for d in doc_ids], np.int64), np.array([d is not None for d in doc_ids])
    out = io.BytesIO()
    np.savez(out, doc_ids=ids[order], known=known[order], lens=lengths[order], terms=all_[first], df=_least_dtype(np.diff(np.append(first, len(all_)))), doc=_least_dtype(doc), tf=_least_dtype(tf))
    return out.getvalue()


def build_index(docs: DataFrame, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """Writes the shards; returns the manifest: uri, n_docs, words."""
    folder = scratch_dir(docs.sparkSession, "bm25")

    def build(batches):
        ids, held = TermIds(), 0
        shard: tuple[list, list, list, list] = ([], [], [], [])

        def close():
            name = f"{folder}/{uuid.uuid4().hex}.npz"
            with open_output(name) as f:
                f.write(pack_shard(*shard))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(shard[0])], pa.int64()), pa.array([int(sum(shard[1]))], pa.int64())], names=["uri", "n_docs", "words"])

        for batch in slices(batches):
            for d, t in zip(batch["doc_id"].to_pylist(), batch["text"]):
                term, tf = ids.of(t.as_py())
                for to, x in zip(shard, (d, int(tf.sum()), term, tf)):
                    to.append(x)
                held += len(term)
                if held >= shard_postings or len(shard[0]) >= SHARD_DOCS:
                    yield close()
                    shard, held = ([], [], [], []), 0
        if shard[0]:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return written(rows.mapInArrow(build, "uri string, n_docs long, words long"), "bm25-manifest")


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term) for each term of each row, from (query_id, text)."""

    def split(batches):
        ids = TermIds()
        for batch in slices(batches):
            for q, t in zip(batch["query_id"].to_pylist(), batch["text"]):
                term = ids.of(t.as_py())[0].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(term), pa.int64()), pa.array(term)], names=["query_id", "term"])

    return queries.select(F.col("query_id").cast("long"), F.col("text").cast("string")).mapInArrow(split, "query_id long, term long")


def weighted_queries(terms: DataFrame, manifest: DataFrame, n_docs: int) -> DataFrame:
    """(query_id, terms, idf), arrays side by side, with document frequencies over all shards."""

    def frequencies(batches):
        for batch in batches:
            for uri in batch["uri"].to_pylist():
                with np.load(io.BytesIO(read_bytes(uri))) as z:
                    names, df = z["terms"], z["df"]
                for lo in range(0, len(names), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(names[lo : lo + 50_000].view(np.int64)), pa.array(df[lo : lo + 50_000].astype(np.int64))], names=["term", "df"])

    files = manifest.select("uri").repartition(shuffle_partitions(manifest.sparkSession))
    df = files.mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    idf = F.log(1 + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    pairs = F.array_sort(F.collect_set(F.struct("term", idf.alias("idf"))))  # a set: a query's rows may repeat a term
    return terms.join(df.hint("merge"), "term").groupBy("query_id").agg(pairs.alias("p")).select("query_id", F.col("p.term").alias("terms"), F.col("p.idf").alias("idf"))


def _take(off: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the slices `at` of an offset array, and the slice number of each."""
    n = off[at + 1] - off[at]
    which = np.repeat(np.arange(len(at)), n)
    return np.arange(n.sum()) + np.repeat(off[at] - np.cumsum(n) + n, n), which


class Shard:
    def __init__(self, raw: bytes, mean_length: float):
        with np.load(io.BytesIO(raw)) as z:
            self.doc_ids, self.known, self.terms, self.doc, self.tf = (z[k] for k in ("doc_ids", "known", "terms", "doc", "tf"))
            df, lens = z["df"].astype(np.int64), z["lens"]
        self.norm = K1 * (1 - B + B * lens / mean_length)
        self.off = np.concatenate([[0], np.cumsum(df)])
        self.doc = self.doc.astype(np.int64)  # as indices, which else are cast for each list
        self.part = self._part(self.tf.astype(np.float32), self.norm.astype(np.float32)[self.doc])
        self.blocks = -(-len(lens) // BLOCK)
        frequent = np.argsort(-df, kind="stable")[:DENSE]
        frequent = frequent[df[frequent] * FREQUENT >= len(lens)]
        self.column = np.full(len(df), -1)
        self.column[frequent] = np.arange(len(frequent))
        pos, which = _take(self.off, frequent)
        dense = np.zeros((self.blocks * BLOCK, len(frequent)), np.float32)
        dense[self.doc[pos], which] = self.part[pos]
        self.dense = dense.reshape(self.blocks, BLOCK, len(frequent))
        self.most = self.dense.max(1)  # of each block and frequent term
        self.dense_tf = np.zeros((len(lens), len(frequent)), self.tf.dtype)
        self.dense_tf[self.doc[pos], which] = self.tf[pos]

    @staticmethod
    def _part(tf, norm):
        return tf * (K1 + 1) / (tf + norm)

    def top(self, queries: list[tuple[np.ndarray, np.ndarray, float]], k: int) -> list[list[tuple[int | None, float]]]:
        """(doc_id, score) of the k best documents here that reach the query's threshold. queries: terms, idf, threshold."""
        weights, rare = np.zeros((len(queries), self.dense.shape[2])), []
        for row, (terms, idf, _) in zip(weights, queries):
            at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
            here = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
            at, w = at[here], idf[here]
            column = self.column[at]
            row[column[column >= 0]] = w[column >= 0]
            rare.append((at[column < 0], w[column < 0]))
        light = weights.astype(np.float32)
        bounds = light @ self.most.T
        out: list[list[tuple[int | None, float]]] = [[]] * len(queries)
        # queries that have their best block in one place need much the same blocks
        order = np.argsort(bounds.argmax(1), kind="stable") if bounds.shape[1] else np.zeros(0, np.int64)
        for lo in range(0, len(order), QUERY_BATCH):
            some = order[lo : lo + QUERY_BATCH]
            lists = [self._list(*rare[i]) for i in some]
            sums = np.empty((len(some), self.blocks * BLOCK), np.float32)
            for row, (pos, w) in zip(sums, lists):
                row[:] = np.bincount(self.doc[pos], self.part[pos] * w, self.blocks * BLOCK)
            most = sums[:, ::BLOCK].copy()  # of each block
            for place in range(1, BLOCK):
                np.maximum(most, sums[:, place::BLOCK], out=most)
            whole = bounds[some] + most
            slack = SLACK + SHARE * whole.max(1)
            least = np.array([queries[i][2] for i in some]) - slack
            read = np.flatnonzero((whole >= least[:, None]).any(0))
            docs = (read[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            scores = light[some] @ self.dense[read].reshape(len(docs), light.shape[1]).T + sums[:, docs]
            for j, i in enumerate(some):
                ahead = np.flatnonzero((scores[j] >= least[j]) & (scores[j] > 0))
                if len(ahead) > k:
                    near = scores[j][ahead]
                    ahead = ahead[near >= np.partition(near, len(near) - k)[len(near) - k] - 2 * slack[j]]
                if len(ahead):
                    out[i] = self._exact(docs[ahead], weights[i], *lists[j], k)
        return out

    def _list(self, terms: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the terms' postings, and the weight of each."""
        n = self.off[terms + 1] - self.off[terms]
        pos = np.repeat(self.off[terms] - np.cumsum(n) + n, n)
        pos += np.arange(len(pos))
        return pos, np.repeat(idf, n)

    def _exact(self, found: np.ndarray, weights: np.ndarray, pos: np.ndarray, idf: np.ndarray, k: int) -> list[tuple[int | None, float]]:
        """The k best of the documents found, scored in 64 bits."""
        mine = np.zeros(self.blocks * BLOCK, bool)
        mine[found] = True
        mine = np.flatnonzero(mine[self.doc[pos]])
        pos, idf = pos[mine], idf[mine]
        score = np.bincount(np.searchsorted(found, self.doc[pos]), self._part(self.tf[pos].astype(float), self.norm[self.doc[pos]]) * idf, len(found))
        score = np.round(score + self._part(self.dense_tf[found].astype(float), self.norm[found][:, None]) @ weights, SCORE_DIGITS)
        best = np.lexsort((self.doc_ids[found], self.known[found], -score))[:k]
        return [(int(self.doc_ids[d]) if self.known[d] else None, s) for d, s in zip(found[best].tolist(), score[best].tolist())]


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dealt(pairs: DataFrame, tasks: int) -> DataFrame:
    """Pairs (uri, slice) in even ranges: a task takes neighbouring ones, so it opens few shards for many slices."""
    return pairs.repartitionByRange(tasks, "uri", "slice").sortWithinPartitions("uri", "slice")


def search(queries: DataFrame, docs: DataFrame, k: int = TOP_K) -> DataFrame:
    """query_id, rank, doc_id, score: the k best documents of each query (query_id, text)."""
    spark = docs.sparkSession
    manifest = build_index(docs)
    stats = manifest.agg(F.sum("n_docs"), F.sum("words"), F.count(F.lit(1))).first()
    n_docs, mean, n_shards = stats[0] or 0, max(1e-9, (stats[1] or 0) / max(1, stats[0] or 0)), stats[2]
    weighted = written(weighted_queries(query_terms(queries), manifest, n_docs), "bm25-queries")
    n_slices = max(1, -(-weighted.count() // QUERY_SLICE))
    weighted = weighted.withColumn("slice", F.pmod(F.xxhash64("query_id"), F.lit(n_slices)).cast("int"))
    place = F.row_number().over(Window.orderBy(F.xxhash64("uri"))) / F.lit(max(1, n_shards))  # a row per shard
    placed = written(manifest.select("uri", place.alias("place")), "bm25-places")
    best, done = None, 0.0
    for until in ROUNDS:
        asked = weighted.withColumn("bar", F.lit(0.0))
        if best is not None:
            bars = best.where(F.col("rank") == k).select(F.col("query_id").alias("q"), F.col("score").alias("b"))
            asked = weighted.join(bars.hint("merge"), F.col("query_id").eqNullSafe(F.col("q")), "left").withColumn("bar", F.coalesce("b", F.lit(0.0))).drop("q", "b")
        folder = scratch_dir(spark, "bm25-asked")
        asked.repartition(n_slices, "slice").write.partitionBy("slice").parquet(folder)

        def look(batches, folder=folder):
            at = None
            for batch in batches:
                for uri, part in zip(batch["uri"].to_pylist(), batch["slice"].to_pylist()):
                    fs, path = pafs.FileSystem.from_uri(f"{folder}/slice={part}")
                    if fs.get_file_info(path).type == pafs.FileType.NotFound:
                        continue  # no query of that number
                    if at != uri:
                        shard, at = Shard(read_bytes(uri), mean), uri
                    for some in pads.dataset(path, format="parquet", filesystem=fs).to_batches(batch_size=QUERIES_READ):
                        asks = [(t.values.to_numpy().view(np.uint64), w.values.to_numpy(), bar) for t, w, bar in zip(some["terms"], some["idf"], some["bar"].to_pylist())]
                        out = [(q, d, s) for q, hits in zip(some["query_id"].to_pylist(), shard.top(asks, k)) for d, s in hits]
                        if out:
                            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "doc_id", "score"])

        pairs = placed.where((F.col("place") > done) & (F.col("place") <= until)).select("uri", F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))).alias("slice"))
        rows = dealt(pairs, shuffle_partitions(spark)).mapInArrow(look, "query_id long, doc_id long, score double")
        if best is not None:
            rows = rows.unionByName(best.select("query_id", "doc_id", "score"))
        best, done = written(_best(rows, k), "bm25-best"), until
    return best.select("query_id", "rank", "doc_id", "score")


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    queries = docs.where(F.col("doc_id") % QUERY_EVERY == 0).select(F.col("doc_id").alias("query_id"), "text")
    return search(queries, docs)


SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS w FROM documents
), tf AS (SELECT doc_id, w, CAST(count(*) AS DOUBLE) AS tf FROM t GROUP BY ALL),
len AS (SELECT doc_id, CAST(sum(tf) AS DOUBLE) AS len FROM tf GROUP BY doc_id),
g AS (SELECT CAST((SELECT count(*) FROM documents) AS DOUBLE) AS n, (SELECT sum(tf) FROM tf) / (SELECT count(*) FROM documents) AS mean),
idf AS (SELECT w, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, g GROUP BY w, n),
s AS (
  SELECT q.doc_id AS query_id, d.doc_id, round(sum(idf * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * len / mean))), 4) AS score
  FROM tf q JOIN tf d USING (w) JOIN idf USING (w) JOIN len ON len.doc_id = d.doc_id, g
  WHERE q.doc_id % 50 = 0 GROUP BY ALL
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""
