"""Toxicity: FTRL-proximal logistic regression over hashed word features.

Features of a text, each present or not, hashed to 64 bits: words, pairs of neighbours, pairs with one
word between (skip-grams), the first 4, 5 and 6 letters of longer words, and those of these beginnings that stand at
two words or more and at an OFTEN-th of the text's words (one such word may be chance in a long text). The model is fitted on at
most about TRAIN_PER_CLASS labelled rows and TRAIN_CHARS characters of each class (those with the smallest hash of the id), in one task:
per-coordinate learning rates, and an L1 penalty that leaves most weights at zero. What is broadcast is
the list of (hash, weight) that remain, which those bounds bound: a feature that counts occurs in MIN_DOCS of these rows. The
intercept is moved by the classes' true log odds, so the bound on rows doesn't shift the scores.

Null and empty texts have no features and score the intercept alone. Very long texts are scored whole. Labels other than 0 and 1, and
labelled ids without a document, are left out of fitting. A repeated id teaches once, with its largest
label and text, so the bound holds whatever repeats; every row is scored. Without a row of
either class the model is empty and every score is 0; an empty table gives no rows. Extra columns are carried; `score` and `predicted` in
the input give way to those of the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, trim, written

TRAIN_PER_CLASS, TRAIN_CHARS, MIN_DOCS = 5_000, 64_000_000, 3
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 8.0, 0.1, 4
THRESHOLD = 0.3
BATCH = 500  # rows of an Arrow batch in fitting, where a row holds a text or its features
FOLDS, HELD_OUT = 4, 2
WORD = re.compile(r"[^\W_]+")
WORD_CACHE = 200_000
STEMS = (4, 5, 6)
OFTEN = 0.005

_U = np.uint64
_PAIR, _SKIP, _OFTEN = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)


class Features:
    """Hashed features of texts; keeps the hashes of the words it has met, up to WORD_CACHE."""

    def __init__(self):
        self._forget()

    def _forget(self):
        self.ids: dict[str, int] = {}
        self.table = np.zeros((1024, 1 + len(STEMS)), _U)

    def _add(self, words) -> None:
        import xxhash

        if len(self.ids) > WORD_CACHE:
            self._forget()
        for w in words:
            if len(self.ids) == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            row = [xxhash.xxh64_intdigest(w, 1)] + [xxhash.xxh64_intdigest(w[:n], n) if len(w) > n else 0 for n in STEMS]
            self.table[len(self.ids)] = row
            self.ids[w] = len(self.ids)

    def of(self, text: str | None) -> np.ndarray:
        """Hashes, with repeats."""
        words = WORD.findall((text or "").lower())
        if not words:
            return np.zeros(0, _U)
        try:
            rows = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        except KeyError:
            distinct = set(words)
            self._add([w for w in distinct if w not in self.ids])
            if not all(w in self.ids for w in distinct):
                self._add([w for w in distinct if w not in self.ids])
            rows = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        h = self.table[rows]
        with np.errstate(over="ignore"):
            one = h[:, 0]
            pairs = (one[:-1] * _PAIR) ^ (one[1:] >> _U(1))
            skips = (one[:-2] * _SKIP) ^ (one[2:] >> _U(1))
        stems = h[:, 1:].ravel()
        stems = stems[stems != 0]
        kept, n = np.unique(stems, return_counts=True)
        with np.errstate(over="ignore"):
            often = kept[n >= max(2, OFTEN * len(words))] * _OFTEN
        return np.concatenate([one, pairs, skips, kept, often])


def fit_ftrl(features: list[np.ndarray], labels: np.ndarray, alpha=ALPHA, beta=BETA, l1=L1, l2=L2, epochs=EPOCHS):
    """(hashes, weights, intercept) of the coordinates that L1 leaves; features: distinct hashes per row."""
    if not len(features):
        return np.zeros(0, _U), np.zeros(0), 0.0
    names = np.concatenate(features)
    names.sort()
    first = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else np.zeros(0, np.int64)
    names = names[first[np.diff(np.append(first, len(names))) >= MIN_DOCS]]
    rows = []
    for f in features:
        at = np.minimum(np.searchsorted(names, f), max(0, len(names) - 1))
        rows.append((at[names[at] == f] if len(names) else at[:0]).astype(np.int32))
    z, n, zb, nb = np.zeros(len(names)), np.zeros(len(names)), 0.0, 0.0

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for x, y in zip(rows, labels.tolist()):
            w, b = weights(z[x], n[x]), -zb / ((beta + nb**0.5) / alpha)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35)))
            g = p - y
            z[x] += g - (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / alpha * w
            n[x] += g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * b
            nb += g * g
    w = weights(z, n)
    top = np.flatnonzero(w)
    return names[top], w[top], -zb / ((beta + nb**0.5) / alpha)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS):
    """Model from docs (doc_id, text) and labels (doc_id, label 0 or 1): (hashes, weights, intercept)."""
    labels = labels.where(F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.groupBy("doc_id").agg(F.max(F.char_length(F.col("text").cast("string"))).alias("chars"))
    named = written(texts.join(labels, "doc_id").select("doc_id", "label", F.coalesce("chars", F.lit(0)).alias("chars")), "toxicity-labels")
    counts = {r["label"]: r for r in named.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")).collect()}
    if 0 not in counts or 1 not in counts:
        return np.zeros(0, _U), np.zeros(0), -35.0
    # the hash is uniform: about per_class rows of each class lie under that share of its range
    shares = {k: min(1.0, per_class / r["n"], TRAIN_CHARS / max(1, r["chars"])) for k, r in counts.items()}
    share = F.when(F.col("label") == 1, F.lit(shares[1])).otherwise(F.lit(shares[0]))
    at = F.xxhash64(F.lit("toxicity"), F.col("doc_id").cast("string"))
    few = written(named.select("doc_id", "label", at.alias("at")).where(F.col("at").cast("double") <= (share * 2 - 1) * 2.0**63), "toxicity-few")
    sample = docs.join(few, "doc_id")  # about 2 * per_class ids: Spark's own check of sizes decides how
    sample = sample.groupBy("doc_id", "label", "at").agg(F.max(F.col("text").cast("string")).alias("text"))

    def features(batches):
        feat = Features()
        for pdf in batches:
            yield pd.DataFrame({"at": pdf["at"], "label": pdf["label"], "f": [np.unique(feat.of(t)).tobytes() for t in pdf["text"]]})
        del feat
        trim()

    def train(batches):
        parts = list(batches)
        pdf = pd.concat(parts) if parts else pd.DataFrame({"at": [], "label": [], "f": []})
        pdf = pdf.sort_values(["at", "label", "f"], kind="stable")
        h, w, b = fit_ftrl([np.frombuffer(x, _U) for x in pdf["f"]], pdf["label"].to_numpy(float))
        y = pdf["label"].to_numpy(float)
        odds = np.log(y.sum() / (1 - y).sum()) if 0 < y.sum() < len(y) else 0.0
        yield pd.DataFrame({"h": [h.tobytes()], "w": [w.tobytes()], "b": [float(b)], "odds": [float(odds)]})
        del parts, pdf
        trim()

    hashed = sample.select("at", F.col("label").cast("int").alias("label"), "text").mapInPandas(features, "at long, label int, f binary")
    row = written(hashed.repartition(1).mapInPandas(train, "h binary, w binary, b double, odds double"), "toxicity-model", BATCH).first()
    b = row["b"] + np.log(counts[1]["n"] / counts[0]["n"]) - row["odds"]
    return np.frombuffer(bytes(row["h"]), _U), np.frombuffer(bytes(row["w"])), float(b)


class Scorer:
    BITS = 22

    def __init__(self, model):
        self.hashes, self.weights, self.bias = model
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[(self.hashes & _U((1 << self.BITS) - 1)).astype(np.int64)] = True
        self.features = Features()

    def score(self, text: str | None) -> float:
        f = self.features.of(text)
        f = np.unique(f[self.maybe[(f & _U((1 << self.BITS) - 1)).astype(np.int64)]])
        total = self.bias
        if len(f) and len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, f), len(self.hashes) - 1)
            total += self.weights[at[self.hashes[at] == f]].sum()
        return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))


def score(docs: DataFrame, model) -> DataFrame:
    """docs with `score`."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(held.value)
        for texts in batches:  # one text at a time becomes a Python string
            yield pa.array((scorer.score(t.as_py()) for t in texts), pa.float64())
        del scorer
        trim()

    return docs.withColumn("score", of(F.col("text").cast("string")))


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted; fitted on the labelled rows of train_docs (else docs) outside the held-out fold."""
    train = (docs if train_docs is None else train_docs).select("doc_id", "text").where(~held_out())
    model = fit(train, labels.select("doc_id", F.col("toxic").alias("label")))
    return score(docs, model).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = classify(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
