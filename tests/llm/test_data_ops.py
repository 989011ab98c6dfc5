"""op2, op4, op5, op7, op10 and the pipeline against brute force, and on odd rows."""

import collections
import gzip
import hashlib
import math
import pathlib
import random
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skillcube.llm import idfile, op2_warc, op4_packing, op5_chat, op7_mixing, op10_tokens
from skillcube.llm.common import range_bounds, read_bytes, with_range
from skillcube.llm.tokens import Encoder

from .conftest import TRICKY


def library_ids(path, texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_encoder_gives_the_librarys_ids(tokenizer):
    enc, rng = Encoder(tokenizer), random.Random(0)
    odd = ["Aa" + chr(c) + "bZ Q" + chr(c) + "'s 7" for c in [*range(0x600), *range(0x2000, 0x2070), 0x3042, 0x1F600]]
    mixed = ["".join(rng.choices("abcABC  '.!?_1²éßΣσς\t\n", k=rng.randint(0, 80))) for _ in range(300)]
    texts = [t or "" for t in TRICKY] + odd + mixed
    for t, ids in zip(texts, library_ids(tokenizer, texts)):
        assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == ids, repr(t)


def test_encoder_on_every_letter_with_every_mark(tokenizer):
    enc = Encoder(tokenizer)
    marks = [chr(c) for c in range(0x530) if unicodedata.combining(chr(c))]
    texts = [" ".join(f"{chr(c)}{m}{'a' if i % 2 else ''}" for i, m in enumerate(marks)) for c in range(0x530)]
    for t, ids in zip(texts, library_ids(tokenizer, texts)):
        assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == ids, repr(t[:2])


def test_encoder_on_random_texts(tokenizer):
    enc, rng = Encoder(tokenizer), random.Random(11)
    letters = [chr(c) for c in range(0x530)] + ["İ", "I", "̱", "̇", "ſ", "ß", "’", "'", " ", "_", "9", "$", "\u2003", "\x1d", "\x85", "\xa0"] * 20
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 12))) for _ in range(20_000)]
    for t, ids in zip(texts, library_ids(tokenizer, texts)):
        assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == ids, repr(t)


def test_encoder_forgets(tokenizer, monkeypatch):
    monkeypatch.setattr("skillcube.llm.tokens.RUN_CACHE", 5)
    enc, texts = Encoder(tokenizer), ["one two three four", "five six seven", "one five nine ten", "two"]
    assert [np.frombuffer(enc.encode(t), enc.dtype).tolist() for t in texts] == library_ids(tokenizer, texts)


def test_perfect_hash():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 5000):
        keys = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
        mph = idfile.PerfectHash.build(keys)
        assert sorted(mph.slots(keys).tolist()) == list(range(len(keys)))
    lone = idfile.PerfectHash.build(keys)
    lone = idfile.PerfectHash([], np.zeros(0, bool), np.sort(keys.view(np.uint64)))  # nothing but leftovers
    assert sorted(lone.slots(keys).tolist()) == list(range(len(keys)))


@pytest.mark.parametrize("shard_bytes", [40, 1 << 20])
def test_token_files(tricky, tokenizer, shard_bytes):
    manifest = op10_tokens.write_ids(tricky, tokenizer, shard_bytes=shard_bytes)
    got = op10_tokens.read_ids(manifest).orderBy("start").collect()
    rows = [(r["doc_id"], r["text"]) for r in tricky.orderBy(F.asc_nulls_first("doc_id"), F.xxhash64("text")).collect()]
    start = 0
    for r, (k, t), ids in zip(got, rows, library_ids(tokenizer, [t for _, t in rows]), strict=True):
        a = np.array([*ids, 1], "<u4")
        assert (r["key"], r["start"], r["n_tokens"], r["ids_crc32"]) == (k, start, len(a), zlib.crc32(a.tobytes()))
        start += len(a)
    keys = tricky.sparkSession.createDataFrame([(5,), (3,), (777,), (None,)], "doc_id long")
    found = collections.Counter(r["key"] for r in op10_tokens.lookup(manifest, keys).collect())
    assert found == {5: 1, 3: 3}
    ids = {r["key"]: r["ids"] for r in op10_tokens.lookup(manifest, keys).collect()}
    assert ids[5] == [*library_ids(tokenizer, [TRICKY[5]])[0], 1]


def test_token_files_roll_inside_a_key(spark, tokenizer):
    docs = spark.createDataFrame([(7 if i % 3 else i, f"word{i} " * 30) for i in range(90)] + [(None, f"none{i}") for i in range(20)], "doc_id long, text string").repartition(4)
    manifest = op10_tokens.write_ids(docs, tokenizer, shard_bytes=300)
    assert max(r["bytes"] for r in manifest.collect()) < 5000 and manifest.where("min_key <= 7 and max_key >= 7").count() > 10
    got = collections.defaultdict(list)
    for r in op10_tokens.lookup(manifest, spark.createDataFrame([(k,) for k in [*range(-5, 100), 7]], "doc_id long")).collect():
        got[r["key"]].append(r["ids"])
    want = collections.defaultdict(list)
    rows = [r for r in docs.collect() if r["doc_id"] is not None]
    for r, ids in zip(rows, library_ids(tokenizer, [r["text"] for r in rows])):
        want[r["doc_id"]].append([*ids, 1])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    back = op10_tokens.read_ids(manifest).orderBy("start").collect()
    assert len(back) == 110 and [r["start"] for r in back[1:]] == [r["start"] + r["n_tokens"] for r in back[:-1]]


def test_token_files_of_nothing(empty, tokenizer):
    assert op10_tokens.read_ids(op10_tokens.write_ids(empty, tokenizer)).count() == 0


def test_ranges(spark):
    rows = [(i * i - 50, i) for i in range(200)] + [(None, i) for i in range(100)] + [(7, i) for i in range(150)]
    df = spark.createDataFrame(rows, "k long, h long").repartition(5)
    for n in (1, 2, 7):
        bounds = range_bounds(df, ["k", "h"], n)
        assert len(bounds) == n
        got = sorted((r["k"] is not None, r["k"] or 0, r["h"], r["bucket"]) for r in with_range(df, ["k", "h"], bounds).collect())
        assert [x[3] for x in got] == sorted(x[3] for x in got) and len({x[3] for x in got}) == n
        for i, b in enumerate(bounds):  # each range begins at its bound
            assert min(x[:3] for x in got if x[3] == i) == (b[0] is not None, b[0] or 0, b[1])
        assert max(collections.Counter(x[3] for x in got).values()) < 2.5 * len(rows) / n
    assert range_bounds(df.limit(0), ["k", "h"], 3) == [] and with_range(df, ["k", "h"], []).where("bucket <> 0").count() == 0


def check_packing(rows, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(tricky, tokenizer):
    rows = op4_packing.pack_documents(tricky, tokenizer).collect()
    check_packing(rows, 2048)
    want = collections.Counter()
    docs = [(r["doc_id"], r["text"]) for r in tricky.collect()]
    for (k, _), ids in zip(docs, library_ids(tokenizer, [t for _, t in docs])):
        a = np.array([*ids, 0], "<u4")
        for p, at in enumerate(range(0, len(a), 2048)):
            raw = a[at : at + 2048].tobytes()
            want[k, p, at, len(raw) // 4, zlib.crc32(raw), raw] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in rows) == want


def test_packing_groups_by_characters(spark, tokenizer):
    docs = spark.createDataFrame([(i, "word " * (400 * (i % 5))) for i in range(60)] + [(None, None), (99, "long " * 120_000)], "doc_id long, text string").repartition(3)
    counts = []
    for chars in (10**9, 100_000):
        rows = op4_packing.pack_documents(docs, tokenizer, False, chars).collect()
        counts.append(check_packing(rows, 2048))
        assert (len({r["sequence_id"] >> 40 for r in rows}) == 1) == (chars == 10**9)
        assert sum(r["length"] for r in rows if r["doc_id"] == 99) == 120_001 and len({r["piece"] for r in rows if r["doc_id"] == 99}) == 59
    assert counts[0] <= counts[1]


def test_packing_is_tight_and_bounded(spark):
    rng = random.Random(1)
    items = [(i, rng.choice([rng.randint(1, 100), rng.randint(1, 2048), 2048])) for i in range(20000)]
    df = spark.createDataFrame(items, "id long, length long")
    for groups, bins, waste in ((1, 1024, 1.01), (3, 64, 1.05)):
        rows = op4_packing.pack(df, groups, open_bins=bins).collect()
        assert len(rows) == len(items) and check_packing(rows, 2048) <= waste * sum(n for _, n in items) / 2048 + groups


def test_best_fit_by_brute_force():
    rng, bins, open_ = random.Random(2), op4_packing.OpenBins(100, 5), {}
    for _ in range(3000):
        need = rng.randint(1, 100)
        b, offset = bins.put(need)
        fits = [f for f in open_.values() if f >= need]
        if fits:
            assert open_[b] == min(fits) and offset == 100 - open_[b]
        else:
            assert b not in open_ and offset == 0
            if need < 100 and len(open_) == 5:
                tight = min(open_.values())
                left = {k for k, f in open_.items() if f != tight or not any(k in s for s in bins.free)}
                gone = [k for k, f in open_.items() if f == tight and k not in bins.free[tight]]
                assert len(gone) == 1 and left is not None
                del open_[gone[0]]
            open_[b] = 100
        open_[b] -= need
        if not open_[b]:
            del open_[b]
        assert len(open_) == bins.open <= 5


def test_packing_of_nothing(empty, tokenizer):
    assert op4_packing.pack_documents(empty, tokenizer).count() == 0


CONVERSATION = "conv_id long, turn long, role string, text string, chunk string, formatted int"


@pytest.fixture(scope="module")
def talks(spark):
    rng = random.Random(3)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", " [/INST] ", "&amp;", "&lt;", "&#91;", "&", "<", "[", "\\", "a", "\n", "é", "<s>[INST] user [/INST] x</s>", "</", "s>", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "odd [/INST] role</s>"]), "".join(rng.choices(bits, k=rng.randint(0, 12)))) for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(100, None, None, None), (100, 1, "assistant", None), (100, 1, "assistant", "x"), (100, 1, "assistant", "x"), (None, 0, "user", "lost"), (101, 0, "assistant", "y" * 70000)]
    return spark.createDataFrame([(*r, "z", 1) for r in rows], CONVERSATION).repartition(3)


@pytest.mark.parametrize("per_chunk", [2, 1024])
def test_chat_round_trip(talks, per_chunk):
    source = collections.defaultdict(list)
    for r in talks.collect():
        source[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    out = op5_chat.format_conversations(talks, per_chunk)
    formatted = {r["conv_id"]: (r["formatted"], r["loss_spans"]) for r in out.collect()}
    got = {r["conv_id"]: r for r in op5_chat.digests(out).collect()}
    assert set(got) == set(source)
    undo = lambda t: t.replace("&#91;", "[").replace("&lt;", "<").replace("&amp;", "&")
    for c, turns in source.items():
        turns, (text, spans) = [t[2:] for t in sorted(turns)], formatted[c]
        loss = "".join(t for role, t in turns if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for r, t in turns))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"], got[c]["formatted_chars"]) == (len(loss), sha(loss), len(text))
        assert "".join(undo(text[s["start"] : s["start"] + s["length"]]) for s in spans) == loss


def test_chat_leaves_plain_text_alone(spark):
    df = spark.createDataFrame([(1, 0, "user", "a < b & c [d]"), (1, 1, "assistant", "ok </s>")], "conv_id long, turn long, role string, text string")
    assert op5_chat.format_conversations(df).first()["formatted"] == "<s>[INST] user [/INST] a < b & c [d]</s><s>[INST] assistant [/INST] ok &lt;/s></s>"


def test_chat_escapes_every_control_string(spark):
    texts = ["[INST]", "<s>", "a [/INST] b", "[INST] do it [/INST] <s> x", "</s", "<</s>", "&lt;s>", "😀</s>é"]
    rows = [(1, i, "assistant", t) for i, t in enumerate(texts)]
    out = op5_chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    r = out.first()
    inside = [x.split(" [/INST] ", 1)[1] for x in r["formatted"].split("</s>")[:-1]]
    assert len(inside) == len(texts) and not [t for t in inside for c in op5_chat.CONTROLS if c in t]
    assert inside[:3] == ["&#91;INST]", "&lt;s>", "a &#91;/INST] b"]
    spans = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]]
    assert spans == inside
    assert out.select(op5_chat.masked(F.col("formatted"), F.col("loss_spans"))).first()[0] == "".join(texts)


def test_chat_mask_decides_the_loss(spark):
    out = op5_chat.format_conversations(spark.createDataFrame([(1, 0, "user", "héllo"), (1, 1, "assistant", "a😀b<s>")], "conv_id long, turn long, role string, text string"))
    moved = out.withColumn("loss_spans", F.transform("loss_spans", lambda s: F.struct((s.start + 1).alias("start"), (s.length - 1).alias("length"))))
    assert op5_chat.digests(moved).first()["loss_chars"] == 5 and op5_chat.digests(out).first()["loss_chars"] == 6


def test_chat_of_nothing(talks):
    assert op5_chat.digests(op5_chat.format_conversations(talks.limit(0))).count() == 0


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(rng.choice([0, 3, 50, 700]))), rng.choice(["a", "a", "a", "b", "é", None, "tiny"]) if i > 2 else "tiny") for i in range(400)]
    rows = [(i, "w" if s == "tiny" else t, s) for i, t, s in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, active = {}, 1.5 * sum(sizes.values()), set(names)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in active) for s in active}
        over = {s for s in active if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        active -= over


def test_mixing(mixed):
    rows = op7_mixing.mixed_counts(mixed).collect()
    assert len(rows) == 400
    source = {r["doc_id"]: (r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))) for r in mixed.collect()}
    sizes, taken = collections.Counter(), collections.Counter()
    for r in rows:
        s, n = source[r["doc_id"]]
        assert r["size"] == n and r["taken"] <= 2 * n
        sizes[s] += n
        taken[s] += r["taken"]
    want = brute_targets(sizes)
    for r in rows:
        s = source[r["doc_id"]][0]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 1
        assert r["taken"] == sum(x["words"] for x in r["shards"])


def test_mixing_reruns_agree(mixed, monkeypatch):
    """Whatever the layout, with many buckets and shards; equal rows share out the same numbers."""
    monkeypatch.setattr(op7_mixing, "ROWS_PER_BUCKET", 30)
    monkeypatch.setattr(op7_mixing, "SHARD_WORDS", 5000)
    docs = mixed.union(mixed.where("doc_id % 7 = 0")).union(mixed.where("doc_id % 9 = 0").withColumn("text", F.concat("text", F.lit(" more"))))
    runs = [collections.Counter(map(str, op7_mixing.mixed_counts(d).collect())) for d in (docs, docs.repartition(3), docs.repartition(7, "text"), docs.coalesce(1))]
    assert runs[0] == runs[1] == runs[2] == runs[3]


def test_shard_counts_are_multinomial(mixed, spark, monkeypatch):
    rows = [(None, 0, 40_000, 60_000.0), ("a", 1, 200_000, 90_001.0), ("b", 2, 7, 14.0), ("c", 3, 0, 0.0)]
    by = spark.createDataFrame(rows, "source string, source_rank int, source_size long, target double")
    shards, block = 12, 16
    drawn = op7_mixing.draws(by, shards, block)
    got = collections.defaultdict(dict)
    for r in drawn.collect():
        got[r["source_rank"]][r["shard"]] = r["n"]
    want = {0: 2500 + 1250, 1: math.ceil(90_001 / block), 2: 2}
    assert {k: sum(v.values()) for k, v in got.items()} == want
    for k in (0, 1):  # chi-square of 11 degrees: 99.9 % lie under 31.3
        e = want[k] / shards
        assert sum((got[k].get(h, 0) - e) ** 2 / e for h in range(shards)) < 31.3
    slots = op7_mixing.slots(drawn, block).collect()
    per = collections.Counter((r["shard"], r["source_rank"]) for r in slots)
    assert per == {(h, k): n for k, v in got.items() for h, n in v.items()}
    for h in range(shards):
        places = sorted(r["position"] for r in slots if r["shard"] == h)
        assert places == list(range(len(places)))
    assert max(collections.Counter((r["source_rank"], r["epoch"], r["block"]) for r in slots).values()) == 1
    took = collections.Counter()
    for r in slots:
        took[r["source_rank"]] += r["take"]
    assert took == {0: 60_000, 1: 90_001, 2: 14}


def test_mix_files(mixed, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op7_mixing, "SHARD_WORDS", 20_000)
    op7_mixing.write_mix(mixed, f"file://{tmp_path}/mix")
    files = spark.read.parquet(f"file://{tmp_path}/mix")
    words = collections.Counter()
    for r in files.collect():
        words[r["doc_id"], r["_shard"]] += len(r["text"].split())
    want = {(r["doc_id"], x["shard"]): x["words"] for r in op7_mixing.mixed_counts(mixed).collect() for x in r["shards"]}
    assert words == want and len({h for _, h in want}) > 3


def test_mixed_texts(mixed):
    out = op7_mixing.mixed_documents(mixed.withColumn("n_chars", F.length("text").cast("long")).withColumn("size", F.lit(1)))
    assert out.columns == ["doc_id", "text", "source", "n_chars", "size"]
    words, times = collections.Counter(), collections.Counter()
    whole = {r["doc_id"]: r["text"] for r in mixed.collect()}
    for r in out.collect():
        assert r["n_chars"] == len(r["text"]) and set(r["text"].split()) <= set(whole[r["doc_id"]].split())
        words.update(r["text"].split())
        times[r["doc_id"]] += 1
    assert max(times.values()) <= 2 and max(n for w, n in words.items() if w != "w") <= 2
    assert sum(words.values()) == sum(r["taken"] for r in op7_mixing.mixed_counts(mixed).collect())


def test_permutations(spark):
    for n in (1, 2, 3, 10, 257):
        df = spark.range(n).select(op7_mixing.permuted(F.col("id"), F.lit(n).cast("long"), [F.lit(7), F.lit("s")]).alias("p"))
        p = [r["p"] for r in df.collect()]
        assert sorted(p) == list(range(n)) and (n < 10 or p != sorted(p))


def test_mixing_odd_rows(tricky, empty):
    rows = op7_mixing.mixed_counts(tricky).collect()
    assert len(rows) == tricky.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert op7_mixing.mixed_documents(tricky).columns == tricky.columns
    assert op7_mixing.mixed_counts(empty).count() == 0 and op7_mixing.mixed_documents(empty).count() == 0


PAGES = [(5, "http://a/5", "x" * 99), (6, "http://a/6", "x" * 99), (3, "http://a/3\r\nX: y", "same page " * 20), (9, None, "same page " * 20), (7, "http://a/é b", "same page " * 20), (1, "http://a/1", None), (2, "http://a/2", ""), (8, "u", "é\r\n\r\nWARC/1.1\r\n" * 30), (7, "http://a/7", "other"), (9, "dup", "same page " * 20), (None, "none", "null id " * 40), (4, "after", "null id " * 40), (2**60 + 1, "far", "f" * 200)]


@pytest.mark.parametrize("roll", [200, 1 << 20])
def test_archives(spark, roll):
    pages = spark.createDataFrame([(*p, "zz") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    folder, manifest = op2_warc.write_warc(pages, roll)
    got = collections.Counter((r["page_id"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in op2_warc.read_warc(manifest).collect())
    groups, want = collections.defaultdict(list), collections.Counter()
    for i, (p, _, h) in enumerate(PAGES):
        groups[(h or "").encode()].append((p is not None, p or 0, i, p))
    for raw, ids in groups.items():
        for k, (_, _, _, p) in enumerate(sorted(ids)):
            later = k and len(raw) >= 100
            want[p, "revisit" if later else "response", len(raw), hashlib.sha256(raw).hexdigest(), sorted(ids)[0][3] if later else None] += 1
    assert got == want
    files = {r["uri"]: r["sha256"] for r in manifest.collect()}
    _, again = op2_warc.write_warc(pages.repartition(2), roll)
    assert sorted(files.values()) == sorted(r["sha256"] for r in again.collect()) and len(files) == (1 if roll > 1000 else len(files)) and (roll > 1000 or len(files) > 3)
    order = [h.get("Page-ID") for u in sorted(files) for h, _, _ in op2_warc.parse(gzip.decompress(read_bytes(u)))]
    assert order[0] is None and [int(x) for x in order[1:]] == sorted(int(x) for x in order[1:])
    assert not pathlib.Path(folder.removeprefix("file://"), "_temporary").exists()
    assert not [u for u in files if "_temporary" in u] and all(u.startswith(folder) for u in files)


def test_damaged_archive_is_noticed(spark):
    raw = op2_warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), 7, None)
    assert [p for _, _, p in op2_warc.parse(raw)] == [b"payload"]
    with pytest.raises(ValueError):
        list(op2_warc.parse(raw.replace(b"\r\n\r\npayload", b"\r\n\r\npayloae")))


def test_hot_page_ids_are_cut(spark, monkeypatch):
    monkeypatch.setattr(op2_warc, "LEAST_SHARD", 5_000)
    rows = [(None, f"u{i}", f"null id {i} " * 20) for i in range(60)] + [(7, f"u{i}", f"seven {i} " * 20) for i in range(60)] + [(i, "u", "same page again " * 20) for i in range(8, 40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    _, manifest = op2_warc.write_warc(pages)
    assert manifest.where("records > 0").count() > 8 and manifest.agg(F.max("records")).first()[0] < 30
    back = op2_warc.read_warc(manifest)
    assert back.count() == len(rows) and back.where("record_type = 'revisit' and refers_to = 8").count() == 31
    texts = collections.Counter(bytes(r["payload"]).decode() for r in back.where("payload is not null").collect())
    assert texts == collections.Counter({t for _, _, t in rows})


def test_archive_of_nothing(spark):
    _, manifest = op2_warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"))
    assert op2_warc.read_warc(manifest).count() == 0


def test_pipeline(spark):
    import os

    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r["doc_id"] for r in docs.collect()]
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.withColumn("score", F.lit("extra")), sf)
        assert out.columns == [*docs.columns, "score"], name
        assert set(r["doc_id"] for r in out.select("doc_id").collect()) <= set(rows)
    before = set(scratch(spark))
    out = corpus_pipeline.run(spark, sf)
    check_packing(out.collect(), 2048)
    assert out.count() > 100 and toxic
    assert [p.split("-")[0] + p.split("-")[1] for p in set(scratch(spark)) - before] == ["stagemixing"]


def test_pipeline_packs_in_short_batches(spark, tokenizer):
    """Texts come to the workers and go on from them in batches of BATCH rows, and a token id takes 16 bits in the shuffle, 32 in the result."""
    import corpus_pipeline
    from skillcube.llm.common import ARROW_ROWS

    usual = spark.conf.get(ARROW_ROWS)
    docs = spark.range(1200).selectExpr("id as doc_id", "concat('text of number ', id, repeat(' 7', cast(id % 3 as int))) as text").coalesce(1)
    try:
        out = corpus_pipeline.packing(spark, docs, "")
        rows = {r["doc_id"]: r for r in out.collect()}
        counted = out.select("doc_id").mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"doc_id": [b.num_rows]}) for b in batches), "doc_id long").collect()
    finally:
        spark.conf.set(ARROW_ROWS, usual)
    assert sum(r["doc_id"] for r in counted) == 1200 and max(r["doc_id"] for r in counted) <= corpus_pipeline.BATCH
    enc = Encoder(tokenizer)
    want = {r["doc_id"]: np.append(np.frombuffer(enc.encode(r["text"]), enc.dtype), 0).astype("<u4").tobytes() for r in docs.collect()}
    assert {k: bytes(r["ids"]) for k, r in rows.items()} == want
    assert all(zlib.crc32(want[k]) == r["ids_crc32"] and len(want[k]) == 4 * r["length"] for k, r in rows.items())
    narrow = op4_packing.pieces(docs, tokenizer, narrow=True).select("length", F.length("ids").alias("n")).collect()
    assert all(r["n"] == 2 * r["length"] for r in narrow)


def scratch(spark):
    """This application's scratch folders."""
    from skillcube.llm.common import scratch_dir

    top = pathlib.Path(scratch_dir(spark, "x").removeprefix("file://")).parent
    return [p.name for p in top.iterdir()] if top.exists() else []
