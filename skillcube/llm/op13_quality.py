"""Quality rules with robust multivariate outliers: a minimum-covariance-determinant estimate per language and source.

Each text gets statistics (words, code points in words, symbols, repeated lines, words in repeated windows). Texts that fail the base rule
go; of the others a vector of transformed rates (`VECTOR`) is held against the estimate of its group, and those whose squared Mahalanobis
distance passes the chi-square quantile at KEEP are rejected.

The estimate is the mean and covariance of the share SUBSET of a group's rows with the smallest distances, which a few concentration steps find from
quartiles; all rows of all documents take part. A step is one aggregation: rows are counted and their (whole-numbered) moments added up
by group and bin of the distance on the way to the shuffle, so a group with a third of all rows is bins to it like any other, and the bins up to
that which reaches the share give the next estimate. Sums of whole numbers don't depend on their order, so reruns and other layouts agree.
A part of FLOORS is added to each variance: a rate that is zero in most rows would have none, and any other value would be infinitely far.

A group with under MIN_ROWS rows joins the other small sources of its language, those of small languages come together; rows of a last group that is
still small get no verdict but the base rule's. Estimates of up to BROADCAST_GROUPS groups are broadcast, of more joined by shuffle.

Null and empty texts have no words and fail the base rule. A null lang or source is a value like any other. A very long text is counted by
its task as a whole, its words piece by piece. Repeated rows count as often as they occur and get equal verdicts. Columns are carried but for `text` (carried
with keep_text); those with the names of results give way to them. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import pieces, table, window_slots, written

MIN_WORDS, MOST_REPEATED_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Standard deviations whose squares are added to the variances of log word length, symbols, repeated lines and repeated windows a word.
VECTOR, FLOORS = ("x0", "x1", "x2", "x3"), (0.05, 0.08, 0.08, 0.15)
SCALE = 256  # vectors are whole multiples of 1 / SCALE
SUBSET, STEPS, KEEP = 0.5, 4, 0.9999
BINS = 16  # of the distance, an e-fold
MIN_ROWS, BROADCAST_GROUPS = 40, 20_000
CHUNK_BYTES = 1_000_000


def chi_square(x: float) -> tuple[float, float]:
    """The distribution functions of 4 and of 6 degrees of freedom."""
    y = x / 2
    return 1 - np.exp(-y) * (1 + y), 1 - np.exp(-y) * (1 + y + y * y / 2)


def quantile(p: float) -> float:
    """The chi-square quantile of 4 degrees of freedom, by halving."""
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid)[0] < p else (lo, mid)
    return hi


CUT = quantile(KEEP)
#: What makes the covariance of a normal sample's inner SUBSET that of the sample.
CONSISTENCY = SUBSET / chi_square(quantile(SUBSET))[1]


def statistics_of(texts: list[bytes]) -> np.ndarray:
    """STATS of each text, a row each."""
    out, ids, at = np.zeros((len(texts), len(STATS)), np.int64), [], 0
    for row, t in zip(out, texts):
        row[2] = len(t) - len(t.translate(None, SYMBOLS))
        seen: set[bytes] = set()
        lines = 0
        for line in t.split(b"\n"):
            if line.strip():
                lines += 1
                seen.add(line)
        row[3] = lines - len(seen)
        number = defaultdict(count(at).__next__)  # texts share no number, so no window of two texts stands twice
        for piece in pieces(t):
            words = piece.split()
            row[0] += len(words)
            row[1] += len(b"".join(words).decode())
            ids.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        at += len(number)
    w = np.concatenate([np.zeros(0, np.int32), *ids])
    if len(w) >= 3:
        out[:, 4] = np.bincount(np.repeat(np.arange(len(texts)), out[:, 0])[repeated_windows(w)], minlength=len(texts))
    return out


def repeated_windows(w: np.ndarray) -> np.ndarray:
    """Whether each place is in a window of three numbers that stands twice or more: windows alone in their slot don't, the others are compared."""
    slot = window_slots(w, 3)
    some = np.flatnonzero(np.bincount(slot)[slot] >= 2)
    wide = w.astype(np.int64) if len(some) else w
    pair = np.unique(wide[some] * (int(w.max()) + 1) + wide[some + 1], return_inverse=True)[1]
    _, which, n = np.unique(pair * (int(w.max()) + 1) + wide[some + 2], return_inverse=True, return_counts=True)
    inside = np.zeros(len(w), bool)
    for k in range(3):
        inside[some[n[which] >= 2] + k] = True
    return inside


def statistics(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """docs with STATS in place of text (or beside it)."""
    names = [c for c in docs.columns if c not in (*STATS, *(() if keep_text else ("text",)))]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("text").cast("string").alias("_text"))
    schema = StructType([rows.schema["_row"]])
    for s in STATS:
        schema = schema.add(s, LongType())

    def of(batches):
        for batch in batches:
            some, held, lo = [], 0, 0
            for i, t in enumerate(batch.column(1)):
                some.append(t.as_buffer().to_pybytes() if t.is_valid else b"")
                held += len(some[-1])
                if held >= CHUNK_BYTES or i + 1 == batch.num_rows:
                    counted = statistics_of(some)
                    columns = [batch.column(0).slice(lo, len(some)), *(pa.array(counted[:, k]) for k in range(len(STATS)))]
                    yield pa.RecordBatch.from_arrays(columns, names=["_row", *STATS])
                    some, held, lo = [], 0, i + 1

    return rows.mapInArrow(of, schema).select("_row.*", *STATS)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def vectors() -> list[Column]:
    """The vector of a row with words, as whole numbers."""
    rates = [F.asinh(F.sqrt(F.col(c) / F.col("n_words"))) for c in ("n_symbols", "n_dup_lines", "n_repeat_words")]
    return [F.round(SCALE * x).cast("long").alias(name) for name, x in zip(VECTOR, [F.log(F.col("word_chars") / F.col("n_words")), *rates])]


def grouped(rows: DataFrame) -> DataFrame:
    """rows (lang, source) with `g`: struct of pooling level, lang and source; null where there are too few rows for an estimate."""
    n = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    own = F.col("n") >= MIN_ROWS
    rest = n.where(~own).groupBy("lang").agg(F.sum("n").alias("of_lang"))
    last = rest.where(F.col("of_lang") < MIN_ROWS).agg(F.coalesce(F.sum("of_lang"), F.lit(0))).first()[0]
    none = F.lit(None).cast("string")
    of = lambda level, lang, source: F.struct(F.lit(level).alias("level"), lang.cast("string").alias("lang"), source.cast("string").alias("source"))
    pool = F.when(F.col("of_lang") >= MIN_ROWS, of(1, F.col("lang"), none))
    pool = pool.otherwise(of(2, none, none)) if last >= MIN_ROWS else pool
    keys = n.select("lang", "source", own.alias("own")).join(rest.withColumnRenamed("lang", "_l"), F.col("lang").eqNullSafe(F.col("_l")), "left")
    keys = written(keys.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), F.when(F.col("own"), of(0, F.col("lang"), F.col("source"))).otherwise(pool).alias("g")), "quality-groups")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_GROUPS else keys
    return rows.join(keys, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s"))).drop("_l", "_s")


PAIRS = [(i, j) for i in range(len(VECTOR)) for j in range(i, len(VECTOR))]
CENTER, PRECISION = [f"c{i}" for i in range(len(VECTOR))], [f"p{i}{j}" for i, j in PAIRS]


def _estimate(means: np.ndarray, covariances: np.ndarray) -> dict[str, np.ndarray]:
    """Columns of an estimate per row: center and inverse of the floored covariance."""
    p = np.linalg.inv(covariances + np.diag(np.square(FLOORS)))
    return {**{c: means[:, i] for i, c in enumerate(CENTER)}, **{c: p[:, i, j] for c, (i, j) in zip(PRECISION, PAIRS)}}


def _schema(rows: DataFrame) -> StructType:
    out = StructType([rows.schema["g"]])
    for c in (*CENTER, *PRECISION):
        out = out.add(c, "double")
    return out


def from_quartiles(rows: DataFrame) -> DataFrame:
    """A first estimate per group: medians, and squares of the quartiles' distance as of a normal sample. Their histograms have bounds, as vectors are whole numbers of some thousands at most."""
    q = rows.groupBy("g").agg(*[F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(x) for x in VECTOR])

    def of(batches):
        for pdf in batches:
            if len(pdf):
                at = np.array([[list(v) for v in pdf[x]] for x in VECTOR]).transpose(1, 0, 2) / SCALE  # row, variable, quartile
                var = np.square((at[:, :, 2] - at[:, :, 0]) / 1.349)
                yield pd.DataFrame({"g": pdf["g"], **_estimate(at[:, :, 1], var[:, :, None] * np.eye(len(VECTOR)))})

    return q.mapInPandas(of, _schema(rows))


def distance(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """rows with `distance`: squared Mahalanobis, null without an estimate."""
    e = estimates.withColumnRenamed("g", "_g")
    e = F.broadcast(e) if estimates.count() <= BROADCAST_GROUPS else e
    off = [F.col(x) / SCALE - F.col(c) for x, c in zip(VECTOR, CENTER)]
    d = sum(((1 if i == j else 2) * F.col(p) * off[i] * off[j] for p, (i, j) in zip(PRECISION, PAIRS)), F.lit(0.0))
    return rows.join(e, F.col("g") == F.col("_g"), "left").withColumn("distance", F.greatest(d, F.lit(0.0))).drop("_g", *CENTER, *PRECISION)


def concentrate(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """The estimate of each group from the bins of least distance that hold SUBSET of its rows."""
    near = distance(rows, estimates).withColumn("bin", F.floor(F.log(F.col("distance") + 1e-6) * BINS).cast("int"))
    whole = lambda c: F.sum(c.cast("decimal(20,0)"))
    sums = [whole(F.col(x)).alias(f"s{i}") for i, x in enumerate(VECTOR)] + [whole(F.col(VECTOR[i]) * F.col(VECTOR[j])).alias(f"s{i}{j}") for i, j in PAIRS]
    bins = near.groupBy("g", "bin").agg(F.count(F.lit(1)).alias("n"), *sums)
    w = Window.partitionBy("g")
    before = F.coalesce(F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = bins.withColumn("before", before).withColumn("all", F.sum("n").over(w)).where(F.col("before") < F.col("all") * SUBSET)
    names = [f"s{i}" for i in range(len(VECTOR))] + [f"s{i}{j}" for i, j in PAIRS]
    totals = inner.groupBy("g").agg(F.sum("n").alias("n"), *[F.sum(s).cast("double").alias(s) for s in names])

    def of(batches):
        for pdf in batches:
            if len(pdf):
                n, k = pdf["n"].to_numpy(float), len(VECTOR)
                means = pdf[names[:k]].to_numpy(float) / n[:, None] / SCALE
                cov = np.zeros((len(pdf), k, k))
                for s, (i, j) in zip(names[k:], PAIRS):
                    cov[:, i, j] = cov[:, j, i] = pdf[s].to_numpy(float) / n / SCALE**2 - means[:, i] * means[:, j]
                yield pd.DataFrame({"g": pdf["g"], **_estimate(means, cov * CONSISTENCY)})

    return totals.mapInPandas(of, _schema(rows))


def estimates_of(rows: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant estimates of the groups of rows (g, vector)."""
    estimates = written(from_quartiles(rows), "quality-estimates")
    for _ in range(STEPS):
        estimates = written(concentrate(rows, estimates), "quality-estimates")
    return estimates


def judge(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """docs (doc_id, text, lang, source) with STATS, base_failed, distance (null without a verdict) and kept."""
    results = (*STATS, *VECTOR, "base_failed", "distance", "kept", "g")
    names = [F.col(f"`{c}`") for c in docs.columns if c not in (*results, *(() if keep_text else ("text",)))]
    counted = statistics(docs.select(F.struct(*names).alias("_doc"), "text", "lang", "source"))
    counted = written(counted.withColumn("base_failed", base_failed()), "quality-statistics")
    some = counted.where("not base_failed").select("*", *vectors())
    rows = written(grouped(some), "quality-vectors")
    fitted = rows.where("g is not null").select("g", *VECTOR)
    judged = distance(rows, estimates_of(fitted)).withColumn("kept", F.coalesce(F.col("distance") <= CUT, F.lit(True)))
    failed = counted.where("base_failed").withColumn("distance", F.lit(None).cast("double")).withColumn("kept", F.lit(False))
    columns = ["_doc.*", *STATS, "base_failed", "distance", "kept"]
    return judged.select(*columns).unionByName(failed.select(*columns))


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judge(docs).select("doc_id", *STATS, "base_failed", "kept")
