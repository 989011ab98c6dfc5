"""Language identification with bit-sliced Bloom filters over character n-grams.

One table of masks serves all languages: each of its positions holds one bit per language, and the
conjunction of an n-gram's HASHES positions is the set of languages that contain it. A text's n-grams
give a popcount per language; each is corrected for that language's false positives (fill ** HASHES),
and the largest corrected share decides.

n-grams are of 3 and 4 letters of the lower-cased words with a blank at either end. Filters are filled
from at most about TRAIN_PER_LANGUAGE labelled rows and TRAIN_CHARS characters of each language (smallest hash of the id): a language
contains an n-gram if MIN_SHARE of its rows do and that share is at least OF_BEST of the largest. So a language has at most
1 / MIN_SHARE times as many n-grams as its rows have on average. Every lang value learns, however rare; a share counts FEW_ROWS rows
more than there are, so that the n-grams of a single row (a slip in lang, say) don't push out those of a language with many. The masks are made and stored in
slices of about SLICE_LANGUAGES languages, of which the driver and a task hold one at a time, so the number of languages has no bound; a batch
of texts goes through one slice after the other, and the best of all slices decides.

Null texts and texts without a letter are `und` with score 0. A text with letters of which no n-gram
is known gets the language with the most labelled rows, with that language's share of them as score
(`und` where there is none). Very long texts are counted whole, in pieces of some CHUNK_CHARS cut where no letter stands (a word longer
than that counts as several). Rows without lang teach nothing; repeated
rows teach as often as they occur. Ties go to the language first in order. Whatever is in lang, doc_id and other columns is not looked
at in prediction; extra columns are carried, `lang_pred`, `score` and `known` give way to those of the result. An empty table gives no
rows and teaches nothing.

The score compares languages with each other, so it is never under one over their number. Whether a text is in its language as a whole
is told by `known`, the share of its n-grams that the language contains, against a bar set on labelled rows: text of two languages or of
none stays under it.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import open_output, read_bytes, scratch_dir, table, trim, written

TRAIN_PER_LANGUAGE, TRAIN_CHARS, MIN_SHARE, OF_BEST = 2_000, 32_000_000, 0.01, 0.2
SLICE_LANGUAGES = 128
FEW_ROWS = 5
BITS_PER_GRAM, HASHES = 16, 3
GRAMS = (3, 4)
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
CHUNK_CHARS = 200_000
#: A text is in its language if that knows BAR_OF times the share of its n-grams that it knows of all but LOW of its labelled rows, or is
#: short of it by no more than CHANCE standard deviations of such a share among as many n-grams.
BAR_OF, LOW, CHANCE = 0.85, 0.01, 2.0

_U = np.uint64
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each n-gram of each text, repeats included."""
    joined = " " + "  ".join(t.lower() for t in texts) + " "
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.fromiter((len(t.lower()) for t in texts), np.int64, len(texts))
    row = np.repeat(np.arange(len(texts)), lengths + 2)[: len(cp)]
    letter = _letters()[cp]
    c = np.where(letter, cp, 32).astype(_U)
    rows, out = [], []
    for n in GRAMS:
        if len(c) < n:
            continue
        inner = np.ones(len(c) - n + 1, bool)
        for i in range(1, n - 1):  # a blank stands at an end only
            inner &= letter[i : len(c) - n + 1 + i]
        at = np.flatnonzero(inner)
        h = np.full(len(at), n, _U)
        with np.errstate(over="ignore"):
            for i in range(n):
                h = h * _U(0x200003) + c[at + i]
        rows.append(row[at])
        out.append(_mix(h))
    return (np.concatenate(rows), np.concatenate(out)) if out else (np.zeros(0, np.int64), np.zeros(0, _U))


def chunks(texts: Iterable[str], size: int | None = None) -> Iterator[tuple[int, list[str]]]:
    """(number of the first, texts) of up to `size` characters together; a longer text stands alone. Texts are taken as they are needed."""
    lo, some, n, size = 0, [], 0, size or CHUNK_CHARS
    for i, t in enumerate(texts):
        if some and n + len(t) > size:
            yield lo, some
            lo, some, n = i, [], 0
        some.append(t)
        n += len(t)
    if some:
        yield lo, some


def pieces(text: str, size: int | None = None) -> Iterator[str]:
    """The text in pieces of up to `size` characters, cut at characters that aren't letters where there is one."""
    at, size = 0, size or CHUNK_CHARS
    while len(text) - at > size:
        end = at + size
        cut = max(text.rfind(c, at + 1, end) for c in (" ", "\n"))
        if cut < 0:
            cut = next((i for i in range(end - 1, at, -1) if not text[i].isalpha()), end)
        yield text[at:cut]
        at = cut
    yield text[at:]


def hashed(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`grams` of one of chunks' lists, piece by piece where it is one long text."""
    if len(texts) > 1:
        yield grams(texts)
    else:
        yield from (grams([p]) for p in pieces(texts[0]))


def _positions(h: np.ndarray, size: int) -> list[np.ndarray]:
    step = (h >> _U(32)) | _U(1)
    with np.errstate(over="ignore"):
        return [((h + _U(k) * step) % _U(size)).astype(np.int64) for k in range(HASHES)]


class Filters:
    """Bloom filters of several languages, sliced by bit: masks[position, word] holds 64 languages a word."""

    def __init__(self, languages: list[str], grams_of: list[np.ndarray]):
        self.languages = languages
        size = max(64, BITS_PER_GRAM * max(map(len, grams_of), default=0))
        self.masks = np.zeros((size, (len(languages) + 63) // 64), _U)
        self.false = np.zeros(len(languages))
        for i, h in enumerate(grams_of):
            bit = _U(1 << (i % 64))
            for at in _positions(h, size):
                self.masks[at, i // 64] |= bit
            self.false[i] = ((self.masks[:, i // 64] & bit) != 0).mean() ** HASHES

    def containing(self, h: np.ndarray) -> np.ndarray:
        """Language bits of each n-gram."""
        a, *rest = _positions(h, len(self.masks))
        found = self.masks[a]
        for at in rest:
            found = found & self.masks[at]
        return found

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected popcounts, texts by languages, and the texts' numbers of n-grams."""
        n = len(texts)
        hits, total = np.zeros((n, len(self.languages))), np.zeros(n)
        for row, h in hashed(texts):
            found = self.containing(h)
            total += np.bincount(row, minlength=n)
            for i in range(len(self.languages)):
                hits[:, i] += np.bincount(row[(found[:, i // 64] >> _U(i % 64)) & _U(1) != 0], minlength=n)
        return np.maximum(0, (hits - total[:, None] * self.false) / np.maximum(1e-9, 1 - self.false)), total

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, languages=np.frombuffer(json.dumps(self.languages).encode(), np.uint8), masks=self.masks, false=self.false)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Filters:
        self = cls.__new__(cls)
        with np.load(io.BytesIO(raw)) as z:
            self.languages, self.masks, self.false = json.loads(z["languages"].tobytes()), z["masks"], z["false"]
        return self


class Model:
    """Filters in slices, each a file of the scratch folder; usual: the language with the most labelled rows, and its share of them."""

    def __init__(self, uris: list[str], usual: str | None, usual_share: float):
        self.uris, self.usual, self.usual_share = uris, usual, usual_share
        self._held: tuple[str, Filters] | None = None

    def slices(self) -> Iterator[Filters]:
        for uri in self.uris:
            if self._held is None or self._held[0] != uri:
                self._held = None
                self._held = uri, Filters.from_bytes(read_bytes(uri))
            yield self._held[1]

    def __getstate__(self):
        return {**self.__dict__, "_held": None}

    def judge(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Languages, scores, the corrected shares of the texts' n-grams that their languages contain, and the numbers of n-grams."""
        n = len(texts)
        names, best, total, known, size = [UNKNOWN] * n, np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        for filters in self.slices():
            for lo, some in chunks(t.as_py() or "" for t in texts):
                c, grams_ = filters.counts(some)
                top = c.argmax(1) if c.shape[1] else np.zeros(len(some), int)
                for i in np.flatnonzero(c.max(1, initial=0) > 0):
                    x, name = c[i, top[i]], filters.languages[top[i]]
                    if x > best[lo + i] or (x == best[lo + i] and name < names[lo + i]):
                        names[lo + i], best[lo + i], known[lo + i] = name, x, x / grams_[i]
                total[lo : lo + len(some)] += c.sum(1)
                size[lo : lo + len(some)] = grams_
        scores = np.divide(best, total, out=np.zeros(n), where=total > 0)
        if self.usual is not None:
            for i in np.flatnonzero(total == 0):
                if any(map(str.isalpha, texts[i].as_py() or "")):
                    names[i], scores[i] = self.usual, self.usual_share
        return names, scores, known, size


def learn(rows: DataFrame, per_language: int | None = TRAIN_PER_LANGUAGE) -> tuple[Model, DataFrame]:
    """The model from rows (doc_id, text, lang), and the sample (lang, text) it was fitted on. per_language None: on every labelled row, however many."""
    spark = rows.sparkSession
    named = rows.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), "doc_id")
    by = written(named.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars")), "langid-counts")
    most = by.orderBy(F.desc("n"), "lang").limit(1).collect()
    n_languages, n_rows = by.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if per_language is None:
        sample = named.select("lang", "text")
    else:
        share = F.least(F.lit(1.0), per_language / F.col("n"), TRAIN_CHARS / F.greatest(F.lit(1), F.col("chars")))
        at = F.xxhash64(F.lit("language"), F.col("doc_id").cast("string")).cast("double")
        few = named.join(by.select("lang", share.alias("share")), "lang")
        sample = written(few.where(at <= (F.col("share") * 2 - 1) * 2.0**63).select("lang", "text"), "langid-sample")
    if not most:
        return Model([], None, 0.0), sample

    def count(batches):
        for batch in batches:
            langs = batch["lang"].to_pylist()
            for lang in dict.fromkeys(langs):
                texts = batch["text"].filter(pa.array([x == lang for x in langs]))
                seen: list[np.ndarray] = []
                for _, some in chunks(t.as_py() for t in texts):
                    parts = list(hashed(some))
                    row, h = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
                    with np.errstate(over="ignore"):
                        once = np.unique(h + row.astype(_U) * _U(0x9E3779B97F4A7C15), return_index=True)[1]
                    seen.append(h[once])
                h, n = np.unique(np.concatenate(seen), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "h", "n"])
        trim()

    sizes = sample.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    counted = sample.mapInArrow(count, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    shares = counted.join(sizes, "lang").withColumn("share", F.col("n") / (F.col("rows") + FEW_ROWS)).where(F.col("share") >= MIN_SHARE)
    best = F.max("share").over(Window.partitionBy("h"))
    slices = -(-n_languages // SLICE_LANGUAGES)
    number = F.pmod(F.xxhash64("lang"), F.lit(slices))
    chosen = shares.withColumn("best", best).where(F.col("share") >= F.col("best") * OF_BEST).select("lang", "h", number.alias("slice"))
    chosen = written(chosen, "langid-grams")
    uris = []
    for s in range(slices):
        languages = sorted(r["lang"] for r in by.where(number == s).select("lang").collect())
        got = chosen.where(F.col("slice") == s).select("lang", "h").toPandas()
        grams_of = {lang: g["h"].to_numpy(np.int64).view(_U) for lang, g in got.groupby("lang")}
        uris.append(f"{scratch_dir(spark, 'langid-filters')}/{s}.npz")
        with open_output(uris[-1]) as f:
            f.write(Filters(languages, [grams_of.get(x, np.zeros(0, _U)) for x in languages]).to_bytes())
    return Model(uris, most[0]["lang"], most[0]["n"] / n_rows), sample


def fit(rows: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> Model:
    return learn(rows, per_language)[0]


def bars(sample: DataFrame, model: Model) -> DataFrame:
    """lang, bar: the least known share of a text in each language, from labelled rows (lang, text) named rightly."""
    right = judged(sample, model).where("lang = lang_pred and known > 0")
    return written(right.groupBy("lang").agg((F.percentile_approx("known", LOW) * BAR_OF).alias("bar")), "langid-bars")


def judged(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score, known and n_grams."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # names of files

    results = ["lang_pred", "score", "known", "n_grams"]

    @F.arrow_udf("lang_pred string, score double, known double, n_grams double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            names, *numbers = held.value.judge(texts)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), *map(pa.array, numbers)], results)
        trim()

    names = [F.col(f"`{c}`") for c in docs.columns if c not in results]
    return docs.select(*names, of(F.col("text").cast("string")).alias("_p")).select(*names, *[f"_p.{c}" for c in results])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score."""
    return judged(docs, model).drop("known", "n_grams")


def in_language(docs: DataFrame, model: Model, least: DataFrame) -> DataFrame:
    """The rows of docs whose text knows enough of its language's n-grams."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = judged(docs.select(F.struct(*names).alias("doc"), "text"), model).join(least.withColumnRenamed("lang", "_l"), F.col("lang_pred") == F.col("_l"), "left")
    bar = F.coalesce("bar", F.lit(0.0))
    least = bar - CHANCE * F.sqrt(bar * (1 - bar) / F.greatest(F.col("n_grams"), F.lit(1.0)))
    return rows.where((F.col("lang_pred") != UNKNOWN) & (F.col("known") > 0) & (F.col("known") >= least)).select("doc.*")


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
