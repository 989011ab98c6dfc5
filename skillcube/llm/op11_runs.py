"""Runs (maximal repetitions) of words in texts, by Lyndon roots, and texts with the repeats taken out.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends; runs of at least
MIN_LENGTH words and MIN_EXPONENT periods are listed. By the runs theorem every run has a Lyndon root that is the longest
Lyndon word from its place on, in an order of the words or in the reverse order. Both Lyndon arrays come directly
from the first phase of Baier's suffix sorter: groups of suffixes with one Lyndon prefix are taken from the
greatest down, and each hands its prefix to the nearest earlier suffixes of lower groups. A root (place, length)
that stands again right behind itself is extended to both sides by longest common extensions, once per stretch and period.

Before that, texts are cut where no run can be: all WIDTH-word windows of a run occur several times within it, so words in
no window that occurs so often are in no run, nor do they extend one. Counting again within what is left goes on while it cuts.
This leaves out no run of any length and period (`window_counts`), and it is why ordinary prose costs little.

Words are `ASCII_WORD` matches of the whole text. Null and empty texts have no words, no runs and an empty collapsed text.
A very long text is handled by its task as a whole, numbered piece by piece: some 70 bytes a word. Repeated rows get equal results, each its own. Extra
columns are carried; `runs` and `collapsed` give way to those of the result. An empty table gives no rows.

`query` plants periodic tails by doc_id as its contract says (a null id plants none).
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from .common import ASCII_WORD, pieces, table, window_slots

MIN_LENGTH, MIN_EXPONENT = 6, 4
WIDTH, ROUNDS = 3, 6
CHUNK_BYTES, PIECE_WORDS = 1_000_000, 1 << 18


def window_counts(min_length: int, min_exponent: int) -> tuple[int, int]:
    """(width, n): the windows of so many words in a run occur at least n times in it, whatever its period; n is 2 or more."""
    for width in range(min(WIDTH, min_length), 0, -1):
        # a run of L words and period q has L - width + 1 windows, each again q words on
        n = min((max(min_length, min_exponent * q) - width + 1) // q for q in range(1, max(min_length, width) + 2))
        if n >= 2:
            return width, n
    raise ValueError("runs have two periods at least")


def stretches(ids: np.ndarray, starts: np.ndarray, width: int, least: int) -> list[tuple[int, int]]:
    """Places [lo, hi) of ids in which all runs are. starts: where texts begin. Windows are counted by hash: those that share one cut less."""
    piece = np.zeros(len(ids), np.int32)
    piece[starts[starts < len(ids)]] = 1
    piece, at, left = np.cumsum(piece, dtype=np.int32), np.arange(len(ids), dtype=np.int32), len(ids) + 1
    for _ in range(ROUNDS):
        if len(at) < width or len(at) >= left:
            break
        left = len(at) * 0.95
        last = len(at) - width + 1
        same = (at[width - 1 :] - at[:last] == width - 1) & (piece[width - 1 :] == piece[:last])
        slot = window_slots(ids[at], width, piece)
        often = same & (np.bincount(slot[same], minlength=1)[np.where(same, slot, 0)] >= least)
        kept = np.zeros(len(at), bool)
        for k in range(width):
            kept[k : last + k] |= often
        at, piece = at[kept], piece[kept]
        if len(at):
            piece = np.cumsum(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(piece) != 0)]), dtype=np.int32)
    if not len(at):
        return []
    first = np.flatnonzero(np.concatenate([[True], np.diff(piece) != 0]))
    lo = at[first]
    return list(zip(lo.tolist(), (lo + np.diff(np.append(first, len(at)))).tolist()))


def lyndon_array(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The length of the longest Lyndon word from each place on; words: numbers, in order; starts: where sequences begin, 0 first.

    Groups are linked in ascending order and taken from the greatest down. `before` and `after` link the places that no group taken so far holds.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(words[order]) != 0, [True]]))
    groups = len(cuts) - 1
    group = np.empty(n, np.int32)
    group[order] = np.repeat(np.arange(groups, dtype=np.int32), np.diff(cuts))
    group = array("i", group.tobytes())
    before, after = np.arange(-1, n - 1, dtype=np.int32), np.arange(1, n + 1, dtype=np.int32)
    before[starts], after[starts[1:] - 1] = -1, n
    before, after, order = array("i", before.tobytes()), array("i", after.tobytes()), array("i", order.astype(np.int32).tobytes())
    members: list = [None] * groups
    size, lower, upper = [1] * groups, list(range(-1, groups - 1)), list(range(1, groups + 1))
    out = array("i", bytes(4 * n))
    g = groups - 1
    while g >= 0:
        mine = members[g] if members[g] is not None else order[cuts[g] : cuts[g + 1]]
        members[g] = ()
        handed, how_often, held, length = array("i"), array("i"), -1, size[g]
        for s in mine:  # ascending, so that `before` is never of this group, and ascends
            if group[s] != g:
                continue
            out[s] = length
            b, a = before[s], after[s]
            if a < n:
                before[a] = b
            if b >= 0:
                after[b] = a
                if b == held:
                    how_often[-1] += 1
                else:
                    handed.append(b)
                    how_often.append(1)
                    held = b
        if handed:
            parts: dict[tuple[int, int], array] = {}
            for p, times in zip(handed, how_often):
                key = group[p], times
                if key in parts:
                    parts[key].append(p)
                else:
                    parts[key] = array("i", (p,))
            # a prefix followed by more repeats of this group's is greater: the most repeats stand right below the next group
            for h, times in sorted(parts, reverse=True):
                new, above, some = len(size), upper[h], parts[h, times]
                size.append(size[h] + times * size[g])
                lower.append(h)
                upper.append(above)
                members.append(some)
                lower[above], upper[h] = new, new
                for p in some:
                    group[p] = new
                # the next one, of fewer repeats, goes between h and this
        g = lower[g]
    return np.frombuffer(out, np.int32).astype(np.int64)


def _forward(w: np.ndarray, i: int, j: int, hi: int) -> int:
    """How many words from i and from j > i on agree, up to hi."""
    n, step = 0, 16
    while j + n < hi:
        m = min(step, hi - j - n)
        differ = w[i + n : i + n + m] != w[j + n : j + n + m]
        at = int(differ.argmax())
        if differ[at]:
            return n + at
        n, step = n + m, step * 2
    return n


def _backward(w: np.ndarray, i: int, j: int, lo: int) -> int:
    """How many words before i and before j > i agree, down to lo."""
    n, step = 0, 16
    while i - n > lo:
        m = min(step, i - n - lo)
        differ = (w[i - n - m : i - n] != w[j - n - m : j - n])[::-1]
        at = int(differ.argmax())
        if differ[at]:
            return n + at
        n, step = n + m, step * 2
    return n


def runs_of(words: np.ndarray, starts: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of sequences of word numbers that stand end to end; starts: where they begin, 0 first."""
    n, found = len(words), set()
    if not n:
        return found
    ends = np.append(starts[1:], n)
    sequence = np.repeat(np.arange(len(starts)), ends - starts)
    for ranks in (words, words.max() - words):
        period = lyndon_array(ranks, starts)
        again = np.minimum(np.arange(n) + period, n - 1)
        root = (np.arange(n) + period < n) & (sequence[again] == sequence) & (words[again] == words)
        if min_exponent >= 3:  # three whole roots at least: that behind it is as long
            root &= period[again] == period
        reach: dict[int, int] = {}
        at = np.flatnonzero(root)
        for i, p, s in zip(at.tolist(), period[at].tolist(), sequence[at].tolist()):
            if i + p < reach.get(p, 0):  # in the stretch of this period that was extended last
                continue
            lo, hi = i - _backward(words, i, i + p, starts[s]), i + p + _forward(words, i, i + p, ends[s])
            reach[p] = hi
            if hi - lo >= max(min_length, min_exponent * p):
                found.add((int(lo), int(hi - lo), p))
    return found


def numbered(text: bytes, number: dict[bytes, int]) -> np.ndarray:
    """Numbers of a text's words."""
    return np.concatenate([np.fromiter(map(number.__getitem__, w), np.int32, len(w)) for p in pieces(text) for w in (p.split(),)])


def detect_texts(texts: list[bytes], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> tuple[list[list[tuple[int, int, int]]], list[bytes]]:
    """Runs of each text, by start and period, and the texts without what a run repeats, words joined by one space."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    ids_of = [numbered(t, number) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(w) for w in ids_of])]).astype(np.int64)
    ids = np.concatenate(ids_of) if ids_of else np.zeros(0, np.int32)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    places = stretches(ids, starts, *window_counts(min_length, min_exponent))
    if places:
        lo, hi = (np.array(x) for x in zip(*places))
        at = np.concatenate([[0], np.cumsum(hi - lo)])
        near = np.concatenate([ids[a:b] for a, b in places])
        for start, length, period in runs_of(near, at[:-1], min_length, min_exponent):
            s = int(np.searchsorted(at, start, "right")) - 1
            place = int(lo[s]) + start - int(at[s])
            t = int(np.searchsorted(starts, place, "right")) - 1
            runs[t].append((place - int(starts[t]), length, period))
    names, out = list(number), []
    for w, mine, text in zip(ids_of, runs, texts):
        mine.sort(key=lambda r: (r[0], r[2]))
        if not mine and len(text) <= CHUNK_BYTES:
            out.append(b" ".join(text.split()))
            continue
        keep = np.ones(len(w), bool)
        for start, length, period in mine:
            keep[start + period : start + length] = False
        w = w[keep]
        out.append(b" ".join(b" ".join(map(names.__getitem__, w[lo : lo + PIECE_WORDS].tolist())) for lo in range(0, len(w), PIECE_WORDS)))
    return runs, out


def _chunks(texts: pa.Array) -> Iterator[list[bytes]]:
    some, held = [], 0
    for t in texts:
        raw = t.as_buffer().to_pybytes() if t.is_valid else b""
        if some and held + len(raw) > CHUNK_BYTES:
            yield some
            some, held = [], 0
        some.append(raw)
        held += len(raw)
    if some:
        yield some


def detect(docs: DataFrame, text: str | Column = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """docs with `runs` (of word numbers, by start and period) and `collapsed` (the text without what runs repeat)."""
    window_counts(min_length, min_exponent)
    names = [c for c in docs.columns if c not in ("runs", "collapsed")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), (F.col(f"`{text}`") if isinstance(text, str) else text).cast("string").alias("collapsed"))
    schema = StructType([rows.schema["_doc"]]).add("runs", ArrayType(StructType().add("start", LongType()).add("length", LongType()).add("period", LongType()))).add("collapsed", StringType())
    kinds = [pa.field(k, pa.int64()) for k in ("start", "length", "period")]

    def of(batches):
        for batch in batches:
            at = 0
            for some in _chunks(batch.column(1)):
                runs, kept = detect_texts(some, min_length, min_exponent)
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in runs])]), pa.int32())
                flat = [x for r in runs for x in r]
                found = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array([x[k] for x in flat], pa.int64()) for k in range(3)], fields=kinds))
                same = batch.column(0).slice(at, len(some))
                yield pa.RecordBatch.from_arrays([same, found, pa.array(kept, pa.binary()).cast(pa.string())], names=["_doc", "runs", "collapsed"])
                at += len(some)

    return rows.mapInArrow(of, schema).select("_doc.*", "runs", "collapsed")


def planted(doc_id: Column, text: Column) -> Column:
    """The text; for a tenth of the ids with its words from a place on replaced by repeats of the first of them."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def plant(w):
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        head = F.slice(w, F.lit(1), a.cast("int"))
        tail = F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda k: F.element_at(w, (a + k % p + 1).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(head, tail), " ")).otherwise(F.lit(""))

    words = F.regexp_extract_all(text, F.lit(f"({ASCII_WORD})"), F.lit(1))
    return F.when(F.coalesce(h % 10 == 0, F.lit(False)), F.element_at(F.transform(F.array(words), plant), 1)).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """Numbers, the longest run and digests of detect's rows."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    return found.select("doc_id", "runs", "collapsed", best.alias("best"), lines.alias("lines")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(detect(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))))


#: Words three in a row that stand again q words on, in stretches; of equal stretches that with the smallest q counts.
SQL = r"""
WITH RECURSIVE bits(n, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8
), split AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT))),
      lambda acc, x: xor(acc >> 8, t[(xor(acc, x) & 255) + 1])), 4294967295) AS h
  FROM documents, crc
), sizes AS (SELECT *, len(ws) AS n, h // 10 AS g FROM split
), plan AS (SELECT *, coalesce(h % 10 = 0 AND n > 0, false) AS planted, g % greatest(n, 1) AS a FROM sizes
), words AS (
  SELECT rid, n, i, ws[CASE WHEN planted AND i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END + 1] AS w
  FROM (SELECT *, unnest(range(n)) AS i FROM plan)
), grams AS (
  SELECT rid, n, i, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM words WINDOW o AS (PARTITION BY rid ORDER BY i)
), pairs AS (
  SELECT x.rid, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.rid = y.rid AND x.w = y.w AND x.w1 = y.w1 AND x.w2 = y.w2 AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), islands AS (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM pairs
), stretches AS (SELECT rid, q, min(i) AS start, count(*) + 2 + q AS length FROM islands GROUP BY rid, q, island
), runs AS (SELECT rid, start, length, min(q) AS q FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY rid, start, length
), dropped AS (SELECT DISTINCT rid, unnest(range(start + q, start + length)) AS i FROM runs
), kept AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS collapsed FROM words ANTI JOIN dropped USING (rid, i) GROUP BY rid
), listed AS (
  SELECT rid, count(*) AS n_runs, arg_min({'s': start, 'l': length, 'q': q}, [-length, start, q]) AS best,
    string_agg(concat_ws(',', start, length, q) || chr(10), '' ORDER BY start, q) AS lines
  FROM runs GROUP BY rid
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, CAST(best.l AS BIGINT) AS length, best.q AS period,
  CAST(1000 * best.l // best.q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM split LEFT JOIN listed USING (rid) LEFT JOIN kept USING (rid)
"""
