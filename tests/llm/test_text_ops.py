"""op1, op3, op6, op8, op9 against brute force, and on odd rows."""

import collections
import hashlib
import math
import os
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skillcube.llm import components, near_copies, op1_toxicity, op3_simhash, op6_langid, op8_search, op9_ctph

from .conftest import TRICKY


def words_of(lang, rng, n):
    syllables = {"en": ["th", "ing", "er", "and"], "fr": ["eau", "oux", "ré", "que"], "de": ["sch", "ung", "keit", "ß"]}[lang]
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng, rows, labels = random.Random(5), [], []
    for i in range(600):
        lang = rng.choice(["en", "fr", "de"])
        text, toxic = words_of(lang, rng, rng.randint(10, 60)), int(rng.random() < 0.25)
        if toxic:
            text += " " + rng.choice(["vilefool", "vilehead", "scoundrel", "vileface"]) + " " + words_of(lang, rng, 5)
        rows.append((i, text, lang, f"s{i % 4}"))
        labels.append((i, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").cache(), spark.createDataFrame(labels, "doc_id long, toxic int").cache()


def test_toxicity_held_out(corpus):
    docs, labels = corpus
    got = op1_toxicity.classify(docs, labels).join(labels, "doc_id").where(op1_toxicity.held_out()).collect()
    assert len(got) > 100 and all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.97


def test_toxicity_repeats_and_bound(corpus):
    docs, labels = corpus
    named = labels.withColumnRenamed("toxic", "label")
    a, b = op1_toxicity.fit(docs, named), op1_toxicity.fit(docs.repartition(5), named)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and a[2] == b[2]
    assert len(op1_toxicity.fit(docs, named, per_class=40)[0]) < len(a[0])


def test_ftrl_equals_plain_steps():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(1, 12, 4).astype(np.uint64)) for _ in range(60)]
    y = np.array([float(3 in r) for r in rows])
    h, w, b = op1_toxicity.fit_ftrl(rows, y, epochs=2)
    z, n, zb, nb = collections.defaultdict(float), collections.defaultdict(float), 0.0, 0.0
    al, be, l1, l2 = op1_toxicity.ALPHA, op1_toxicity.BETA, op1_toxicity.L1, op1_toxicity.L2
    weight = lambda k: 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((be + n[k] ** 0.5) / al + l2)
    for _ in range(2):
        for r, t in zip(rows, y):
            ws, bias = {k: weight(k) for k in r.tolist()}, -zb / ((be + nb**0.5) / al)
            g = 1 / (1 + math.exp(-sum(ws.values()) - bias)) - t
            for k, v in ws.items():
                z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / al * v
                n[k] += g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / al * bias
            nb += g * g
    assert dict(zip(h.tolist(), w.round(9))) == {k: round(weight(k), 9) for k in sorted(z) if weight(k)}
    assert b == pytest.approx(-zb / ((be + nb**0.5) / al))


def brute_features(text):
    import xxhash

    h = lambda w, seed: xxhash.xxh64_intdigest(w, seed)
    w, m = re.findall(r"[^\W_]+", (text or "").lower()), 2**64
    one = [h(x, 1) for x in w]
    out = set(one)
    out |= {(a * 0x9E3779B97F4A7C15 % m) ^ (b >> 1) for a, b in zip(one, one[1:])}
    out |= {(a * 0xC2B2AE3D27D4EB4F % m) ^ (b >> 1) for a, b in zip(one, one[2:])}
    stems = collections.Counter(h(x[:n], n) for x in w for n in (4, 5, 6) if len(x) > n)
    often = {s * 0x165667B19E3779F9 % m for s, n in stems.items() if n >= max(2, op1_toxicity.OFTEN * len(w))}
    return out | set(stems) | often


def test_toxicity_query_by_brute_force(corpus, spark, tmp_path):
    """Training rows, their order, the model, the intercept and all scores, with plain Python in place of Spark."""
    docs, labels = corpus
    long = docs.union(spark.createDataFrame([(7001, "vilefool " + "th ing " * 60_000, "en", "s"), (7002, None, None, None), (7003, "", "en", "s"), (7004, "VileHead, x", "en", "s")], docs.schema))
    long.write.parquet(f"file://{tmp_path}/documents.parquet")
    labels.union(spark.createDataFrame([(10**6, 1), (3, 2)], "doc_id long, toxic int")).write.parquet(f"file://{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in op1_toxicity.query(spark, f"file://{tmp_path}").collect()}
    rows = long.select("doc_id", "text", F.xxhash64(F.lit("toxicity"), F.col("doc_id").cast("string")).alias("at")).collect()
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    train = sorted((r["at"], toxic[r["doc_id"]], r["text"]) for r in rows if not held(r["doc_id"]) and r["doc_id"] in toxic)
    feats, y = [brute_features(t) for _, _, t in train], np.array([float(k) for _, k, _ in train])
    h, w, b = op1_toxicity.fit_ftrl([np.array(sorted(f), np.uint64) for f in feats], y)
    weight = dict(zip(h.tolist(), w.tolist()))
    assert len(got) == len(rows)
    for r in rows:
        total = b + sum(weight.get(f, 0.0) for f in brute_features(r["text"]))
        g = got[r["doc_id"]]
        assert g["score"] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9) and g["held_out"] == held(r["doc_id"]) and g["predicted"] == int(g["score"] >= 0.3)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_toxicity_and_language_on_the_given_tables(spark):
    sf = "/root/testdata/sf0.1"
    scored = op1_toxicity.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = sum(r["toxic"] and r["predicted"] for r in scored)
    assert hit / sum(r["toxic"] for r in scored) > 0.85 and hit / sum(r["predicted"] for r in scored) > 0.95
    lang = op6_langid.query(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(lang) > 2000 and np.mean([r["lang"] == r["lang_pred"] for r in lang]) > 0.98


def test_toxicity_bound_on_characters(corpus, monkeypatch):
    docs, labels = corpus
    named = labels.withColumnRenamed("toxic", "label")
    whole = op1_toxicity.fit(docs, named)
    monkeypatch.setattr(op1_toxicity, "TRAIN_CHARS", 3000)
    assert len(op1_toxicity.fit(docs, named)[0]) < len(whole[0])


def test_toxicity_odd_rows(tricky, empty, corpus):
    _, labels = corpus
    out = op1_toxicity.classify(tricky, labels, corpus[0])
    assert out.count() == tricky.count() and out.where("score is null or predicted is null").count() == 0
    assert set(tricky.columns) <= set(out.columns)
    assert op1_toxicity.classify(empty, labels, corpus[0]).count() == 0
    none = op1_toxicity.classify(tricky, labels.limit(0), corpus[0])
    assert {r["predicted"] for r in none.collect()} == {0}


def test_language_held_out(corpus):
    docs, _ = corpus
    f = op6_langid.fit(docs.where(~op6_langid.held_out()))
    got = op6_langid.predict(docs.where(op6_langid.held_out()), f).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97


def test_language_query_by_brute_force(corpus):
    """With sets of n-grams in place of the filters; the filters' own false positives move a score by little."""
    docs, _ = corpus
    learn = [r for r in docs.where(~op6_langid.held_out()).collect()]

    def grams(t):
        cut = "".join(c if c.isalpha() else " " for c in t.lower())
        words = [f" {w} " for w in cut.split()]
        return [w[i : i + n] for n in (3, 4) for w in words for i in range(len(w) - n + 1)]

    share = {}
    for lang in sorted({r["lang"] for r in learn}):
        rows = [set(grams(r["text"])) for r in learn if r["lang"] == lang]
        share[lang] = {g: n / (len(rows) + op6_langid.FEW_ROWS) for g, n in collections.Counter(g for s in rows for g in s).items()}
    best = collections.Counter()
    for s in share.values():
        best |= collections.Counter(s)
    known = {lang: {g for g, v in s.items() if v >= op6_langid.MIN_SHARE and v >= best[g] * op6_langid.OF_BEST} for lang, s in share.items()}
    got, off = op6_langid.predict(docs, op6_langid.fit(docs.where(~op6_langid.held_out()))).collect(), []
    for r in got:
        count = {lang: sum(g in k for g in grams(r["text"])) for lang, k in known.items()}
        off.append(abs(r["score"] - max(count.values()) / sum(count.values())))
        assert r["lang_pred"] == max(count, key=count.get)
    assert max(off) < 0.1 and np.mean(off) < 0.02


def languages_of(model):
    return sorted(x for f in model.slices() for x in f.languages)


@pytest.mark.parametrize("per_slice", [128, 1])
def test_every_lang_value_learns(spark, corpus, monkeypatch, per_slice):
    """A rare language is learned whatever the others' counts, and slips in lang leave the frequent ones as they are."""
    docs, _ = corpus
    monkeypatch.setattr(op6_langid, "SLICE_LANGUAGES", per_slice)
    pl = "zażółć gęślą jaźń wszystkie człowiek szczęście"
    extra = spark.createDataFrame([(9_001, pl, "pl", "s"), (9_002, words_of("en", random.Random(3), 40), "oops", "s")], docs.schema)
    model = op6_langid.fit(docs.unionByName(extra))
    assert languages_of(model) == ["de", "en", "fr", "oops", "pl"] and len(model.uris) == (5 if per_slice == 1 else 1)
    asked = docs.unionByName(extra.where("lang = 'pl'"))
    got = op6_langid.predict(asked, model).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    assert [r["lang_pred"] for r in got if r["lang"] == "pl"] == ["pl"]


def test_long_texts_are_counted_in_pieces(corpus, monkeypatch):
    docs, _ = corpus
    model = op6_langid.fit(docs)
    texts = pa.array([words_of("fr", random.Random(1), 3_000), None, "x" * 5_000, "été, " * 900 + words_of("de", random.Random(2), 900), "ab"])
    whole = model.judge(texts)
    monkeypatch.setattr(op6_langid, "CHUNK_CHARS", 700)
    cut = model.judge(texts)
    assert whole[0] == cut[0] and np.allclose(np.delete(whole[1], 2), np.delete(cut[1], 2)) and np.allclose(np.delete(whole[2], 2), np.delete(cut[2], 2))
    assert "".join(op6_langid.pieces(texts[3].as_py())) == texts[3].as_py() and max(map(len, op6_langid.pieces("y" * 5_000))) == 700
    monkeypatch.setattr(op6_langid, "CHUNK_CHARS", 200_000)
    long = pa.array(["wort und satz " * 1_500_000])
    tracemalloc.start()
    assert model.judge(long)[0][0] in ("de", "en", "fr")
    assert tracemalloc.get_traced_memory()[1] < 120e6  # 21 million characters; by whole texts it was over a gigabyte
    tracemalloc.stop()


def test_language_odd_rows(tricky, empty, corpus):
    f = op6_langid.fit(corpus[0])
    out = op6_langid.predict(tricky, f).collect()
    assert len(out) == tricky.count()
    for r in out:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
    assert op6_langid.predict(empty, f).count() == 0
    assert {r["lang_pred"] for r in op6_langid.predict(tricky, op6_langid.fit(empty)).collect()} == {"und"}


def test_bloom_masks_and_correction():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**63, 500).astype(np.uint64) for _ in range(70)]
    f = op6_langid.Filters([f"l{i:02d}" for i in range(70)], sets)
    f = op6_langid.Filters.from_bytes(f.to_bytes())
    for i in (0, 63, 64, 69):
        found = f.containing(sets[i])
        assert ((found[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).all()
    other = rng.integers(0, 2**63, 20000).astype(np.uint64)
    found = f.containing(other)
    rate = [((found[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(70)]
    assert np.abs(np.array(rate) - f.false).max() < 0.01 and f.false.max() < 0.05
    assert f.counts(["", "abc def"])[0].max() <= 4 and f.counts(["", "abc def"])[1].tolist() == [0, 10]


def test_grams_by_hand():
    row, h = op6_langid.grams(["Ab c", None or "", "ab"])
    assert np.bincount(row, minlength=3).tolist() == [4, 0, 3]  # " ab", "ab ", " c ", " ab "; " ab", "ab ", " ab "
    assert set(h[row == 2]) <= set(h[row == 0])


def brute_simhash(text, k=3):
    import xxhash

    w = [x for x in re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))]
    sh = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for t in TRICKY:
        assert op3_simhash.fingerprint(t) == brute_simhash(t)


@pytest.mark.parametrize("tile", [3, 2048])
def test_links_by_brute_force(spark, tile):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = sorted({b ^ sum(1 << p for p in rng.sample(range(64), d)) for b in base for d in (0, 1, 2, 3, 2, 1)} | {0, 1, 3, 7, 2**64 - 1})
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    edges = op3_simhash.links(df, 2, tile)
    roots = {r["node"] % 2**64: r["root"] for r in components.components(edges).collect()}
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    groups = lambda f: sorted(sorted(x for x in fps if f(x) == r) for r in {f(x) for x in fps})
    assert groups(root) == groups(lambda x: roots.get(x, x))
    assert all((r["a"] % 2**64 ^ r["b"] % 2**64).bit_count() <= 2 for r in edges.collect())


def test_components_of_a_long_path_and_a_star(spark):
    path = spark.range(0, 300).selectExpr("id as a", "id + 1 as b")
    star = spark.range(1001, 1400).selectExpr("id as a", "1000L as b")
    got = components.components(path.union(star)).groupBy("root").count().collect()
    assert {r["root"]: r["count"] for r in got} == {0: 301, 1000: 400}


def test_near_duplicates_odd_rows(tricky, empty):
    rows = op3_simhash.near_duplicates(tricky).collect()
    assert len(rows) == tricky.count()
    by = {(r["doc_id"], r["fp"]): r["component_id"] for r in rows}
    assert {v for (i, f), v in by.items() if f == 0} == {0} and all(by[k] == 5 for k in by if k[0] in (5, 6))
    kept = op3_simhash.one_per_component(tricky)
    assert kept.columns == tricky.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len({(r["component_id"], r["fp"] if r["component_id"] is None else 0) for r in rows}) and None in ids and ids.count(3) == 1
    assert op3_simhash.near_duplicates(empty).count() == 0 and op3_simhash.one_per_component(empty).count() == 0


def brute_bm25(docs, queries, k=10):
    tok = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    tfs = [(d, collections.Counter(tok(t))) for d, t in docs]
    n, mean = len(docs), sum(sum(c.values()) for _, c in tfs) / len(docs)
    df = collections.Counter(w for _, c in tfs for w in c)
    out = {}
    for q, t in queries:
        s = []
        for d, c in tfs:
            x = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in sorted(set(tok(t))) if c[w])
            if x:
                s.append((-round(x, 4), d))
        out[q] = [(d, -x) for x, d in sorted(s)[:k]]
    return out


@pytest.mark.parametrize("shard,docs_,slice_", [(200, 10**6, 7), (10**6, 10**6, 2048), (10**6, 17, 5)])
def test_search_by_brute_force(corpus, spark, shard, docs_, slice_, monkeypatch):
    rng = random.Random(3)
    docs = [(i, words_of("en", rng, rng.randint(0, 40)) + (f" rare{i % 37}" if i % 5 == 0 else "")) for i in range(300)]
    docs += [(300 + i, docs[7][1]) for i in range(15)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(op8_search.build_index, "__defaults__", (shard,))
    for name, value in {"SHARD_DOCS": docs_, "QUERY_SLICE": slice_, "QUERY_BATCH": 4, "DENSE": 12, "ORDER_TERMS": 9}.items():
        monkeypatch.setattr(op8_search, name, value)
    queries = [(d, t) for d, t in docs if d % 10 == 0] + [(9999, "rare3 rare5 nothing"), (8888, " ".join(t for _, t in docs))]
    got = collections.defaultdict(dict)
    for r in op8_search.search(spark.createDataFrame(queries, "query_id long, text string"), df).collect():
        got[r["query_id"]][r["rank"]] = (r["doc_id"], r["score"])
    for q, want in brute_bm25(docs, queries).items():
        mine = [got[q][i + 1] for i in range(len(got[q]))]
        assert [d for d, _ in mine] == [d for d, _ in want] and all(abs(a - b) < 2e-4 for (_, a), (_, b) in zip(mine, want))


def test_search_of_shards_below_all_bars(corpus, spark, monkeypatch):
    """With many shards the first ones give bars that no block of another shard reaches."""
    docs = [(i, "alpha beta gamma" if i < 20 else f"alpha other{i} " + "filler " * 40) for i in range(200)]
    queries = [(0, "alpha beta gamma")]
    shard = op8_search.Shard(op8_search.pack_shard([1], [41], [np.array([5], np.uint64)], [np.array([1], np.uint32)]), 41.0)
    asked = (np.array([5], np.uint64), np.array([0.1]))
    assert shard.top([(*asked, 99.0)], 10) == [[]] and [d for d, _ in shard.top([(*asked, 0.0)], 10)[0]] == [1]
    monkeypatch.setattr(op8_search, "SHARD_DOCS", 1)
    monkeypatch.setattr(op8_search, "ROUNDS", (0.5, 1.0))
    found = op8_search.search(spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in found] == [(d, pytest.approx(s, abs=2e-4)) for d, s in brute_bm25(docs, queries)[0]]


def test_search_tasks_open_few_shards(spark):
    """However many slices of queries there are, a shard is opened by the tasks that share its pairs, not by all."""
    shards, slices_, tasks = 12, 40, 6
    pairs = spark.range(shards * slices_).selectExpr(f"concat('file:///', id % {shards}) as uri", f"cast(id div {shards} as int) as slice")
    got = op8_search.dealt(pairs, tasks).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r["uri"], r["slice"]) for r in got) == sorted((r["uri"], r["slice"]) for r in pairs.collect())
    assert len({(r["task"], r["uri"]) for r in got}) <= shards + tasks
    assert max(collections.Counter(r["task"] for r in got).values()) <= 2 * shards * slices_ / tasks


def test_search_odd_rows(tricky, empty):
    q = tricky.selectExpr("doc_id as query_id", "text", "size as term")
    got = op8_search.search(q, tricky).collect()
    assert len(got) == len({(r["query_id"], r["rank"]) for r in got})  # repeated query rows are one query
    assert set(got) == set(op8_search.search(q.distinct().union(q), tricky).collect())
    assert [r["doc_id"] for r in got if r["query_id"] is None and r["rank"] == 1] == [None]
    found = {r["query_id"] for r in got}
    assert 0 not in found and 1 not in found and {5, 6, 9, 12} <= found
    best = {r["query_id"]: r["doc_id"] for r in got if r["rank"] == 1}
    assert best[6] == 5 and best[12] == 12
    assert op8_search.search(q, empty.select("doc_id", "text")).count() == 0
    assert op8_search.search(q.limit(0), tricky).count() == 0


def test_piecewise_hash_by_brute_force(spark):
    rng = random.Random(4)
    docs = [(i * 3, words_of("de", rng, rng.randint(0, 300))) for i in range(80)] + [(1000, None), (1001, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in op9_ctph.fingerprints(df).collect()}
    order = sorted(((k, t or "") for k, t in docs), reverse=True)
    assert len(got) == len(docs)
    for i, (k, t) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        e = op9_ctph.edited(t, following)
        r, f, g = got[k], op9_ctph.fingerprint(t), op9_ctph.fingerprint(e)
        assert (r["n_chars"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), f, g) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert r["near_edited"] == op9_ctph.likeness(f, g) and r["near_next"] == op9_ctph.likeness(f, op9_ctph.fingerprint(following))
    long = [r for r in got.values() if r["n_chars"] > 400]
    assert np.mean([r["near_edited"] for r in long]) > 0.4 and np.mean([r["near_next"] for r in long]) < 0.1


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ("".join(rng.choices("abcd", k=rng.randint(0, 30))) for _ in "12")
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert op9_ctph._shared(a, b) == t[-1][-1]


def test_rolling_hash_is_local():
    raw = bytes(random.Random(2).randbytes(3000))
    whole = op9_ctph._triggers(raw, 6)
    shifted = op9_ctph._triggers(b"prefix" + raw, 6) - 6
    assert set(whole[whole > 10]) == set(shifted[shifted > 10])
    assert set(op9_ctph._triggers(raw, 12)) <= set(whole)


def test_signatures_are_bounded_and_cut_dull_texts():
    dull = {"word": "word " * 4000, "letter": "a" * 300_000, "lines": "0123456789abcdef\n" * 250_000, "pair": "ab" * 50_000}
    for name, t in dull.items():
        f = op9_ctph.fingerprint(t)
        assert all(len(s) <= 2 * op9_ctph.SIGNATURE for s in f.split(":")[1:]), name
        assert op9_ctph.likeness(f, op9_ctph.fingerprint(t + "x" * 50)) > 0.8, name
    rng = random.Random(8)
    for n in (1, 2, 30, 200, 3000, 70_000):
        t = "".join(rng.choices("abcdefgh ", k=n))
        f = op9_ctph.fingerprint(t)
        assert all(1 <= len(s) <= 2 * op9_ctph.SIGNATURE for s in f.split(":")[1:])
        raw, size = t.encode(), int(f.split(":")[0])
        ends = op9_ctph._ends(raw, size).tolist()
        assert ends[-1] == len(raw) and ends == sorted(set(ends)) and max(b - a for a, b in zip([0, *ends], ends)) <= 4 * size
        assert set(op9_ctph._triggers(raw, size).tolist()) <= set(ends)


def test_piecewise_hash_of_hot_ids(spark):
    rows = [(None, f"text {i} of no id " * 9) for i in range(70)] + [(5, f"text {i} of five " * 9) for i in range(70)] + [(i, f"own {i} " * 30) for i in range(9, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = op9_ctph.fingerprints(df).collect()
    order = [r["text"] for r in df.orderBy(F.desc_nulls_last("doc_id"), F.xxhash64("text")).collect()]
    want = collections.Counter(hashlib.sha256(op9_ctph.edited(t, order[(i + 1) % len(order)]).encode()).hexdigest() for i, t in enumerate(order))
    assert collections.Counter(r["edited_sha256"] for r in got) == want


def test_piecewise_hash_odd_rows(tricky, empty):
    rows = op9_ctph.fingerprints(tricky).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in tricky.collect())
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (5, 6)}) == 1
    assert op9_ctph.fingerprints(empty).count() == 0
    assert op9_ctph.fingerprints(tricky.where("doc_id = 5")).first()["near_next"] == 1.0


def test_language_stage_rejects_what_no_language_knows(corpus):
    import corpus_pipeline

    docs, _ = corpus
    rng = random.Random(3)
    odd = [(9001, "это русский текст о погоде и людях " * 5), (9002, "日本語のテキスト東京は大きい都市"), (9003, " ".join("".join(rng.choices("bcfjklmpvwxyz", k=6)) for _ in range(60))), (9004, None), (9005, "1 2 3")]
    rows = docs.sparkSession.createDataFrame([(i, t, "en" if i == 9003 else None, "s") for i, t in odd], docs.schema)
    kept = [r["doc_id"] for r in corpus_pipeline.language(docs.sparkSession, docs.union(rows), "").collect()]
    assert sorted(kept) == [r["doc_id"] for r in docs.orderBy("doc_id").collect()]


def test_language_stage_of_nothing(empty):
    import corpus_pipeline

    assert corpus_pipeline.language(empty.sparkSession, empty, "").count() == 0


def edited(words, rng, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.random()}"
    return out


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("tile", [near_copies.TILE, 3])
def test_near_dedup_stage_by_brute_force(spark, tile, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(near_copies, "TILE", tile)
    monkeypatch.setattr(near_copies, "FAN", tile)
    rng, texts = random.Random(7), []
    for _ in range(40):  # originals with copies on either side of 0.8
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randint(60, 300))]
        texts += [" ".join(edited(base, rng, k)) for k in (0, 0, 1, 2, 4, len(base) // 50, len(base) // 30, len(base) // 10)]
    base = [f"w{rng.randrange(500)}" for _ in range(200)]  # a family with most pairs under 0.8 and some over
    texts += [" ".join(edited(base, rng, rng.choice([3, 4, 5, 9]))) for _ in range(30)]
    texts += ["", "one two", "ONE  two", "one two three", "one"]
    rng.shuffle(texts)
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    near = 0
    for j, b in enumerate(texts):
        for i in range(j):
            s = jaccard(texts[i], b)
            near += 0.8 <= s < 1
            if s >= 0.8:
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    assert near > 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(kept) == sorted({root(i) for i in range(len(texts))})


@pytest.mark.parametrize("tile", [op3_simhash.TILE, 5])
def test_wide_fingerprints_by_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(op3_simhash, "TILE", tile)
    rng, rows = np.random.default_rng(4), []
    for base in rng.integers(0, 2**64, (60, 2), np.uint64):
        for _ in range(4):  # around the radius, sizes on either side of the ratio
            flips = [int(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), False))) for _ in base]
            rows.append((len(rows) - 100, int(rng.integers(4, 40)), *[int(np.uint64(int(x) ^ f).view(np.int64)) for x, f in zip(base, flips)]))
    bits = lambda a, b, k: ((a[k] ^ b[k]) & (2**64 - 1)).bit_count()
    far = lambda a, b: bits(a, b, 2) > 9 or bits(a, b, 2) + bits(a, b, 3) > 16 or min(a[1], b[1]) < 0.8 * max(a[1], b[1])
    want = {frozenset((a[0], b[0])) for i, a in enumerate(rows) for b in rows[:i] if not far(a, b)}
    df = spark.createDataFrame(rows, "node long, size long, f0 long, f1 long").repartition(3)
    got = {frozenset((r["a"], r["b"])) for r in op3_simhash.wide_links(df, 2, 16, 9, 0.8).collect()}
    together = lambda pairs: {frozenset(p) for p in (
        lambda root: [[n for n in root if root[n] == k] for k in set(root.values())])(_merged([r[0] for r in rows], pairs))}
    assert got <= want and len(want) > 20 and together(got) == together(want)


def _merged(nodes, pairs):
    root = {n: n for n in nodes}
    for a, b in map(tuple, pairs):
        old, new = root[a], root[b]
        root = {n: new if r == old else r for n, r in root.items()}
    return root


def test_near_dedup_stage_goes_by_simhash(spark, monkeypatch):
    """Links come from fingerprints alone: what these do not name a candidate is kept, what they name is confirmed on exact sets."""
    import corpus_pipeline

    words = [f"w{i}" for i in range(100)]
    docs = spark.createDataFrame([(0, " ".join(words)), (1, " ".join([*words[:-1], "new"])), (2, " ".join(f"v{i}" for i in range(90)))], "doc_id long, text string")
    kept = lambda: sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert kept() == [0, 2]
    found = op3_simhash.wide_links
    monkeypatch.setattr(op3_simhash, "wide_links", lambda *a: found(*a).limit(0))
    assert kept() == [0, 1, 2]
    pair = lambda rows, *_: rows.groupBy().agg(F.min("node").alias("a"), F.max("node").alias("b")).union(rows.select("node", F.lit(rows.first()["node"])))
    monkeypatch.setattr(op3_simhash, "wide_links", pair)  # all three as candidates
    assert kept() == [0, 2]


def test_near_copies_odd_rows(tricky, empty):
    out = near_copies.one_per_group(tricky)
    assert out.columns == tricky.columns
    got = collections.Counter(r["text"] for r in out.collect())
    assert got[None] == 1 and not got[""] and got["a"] == 1 and got["null id"] == 1
    assert near_copies.one_per_group(empty).count() == 0


def test_stages_on_odd_rows(tricky, empty, spark, tmp_path):
    """All columns back, whatever their names; no crash on nulls, repeats and long texts; nothing from nothing."""
    import corpus_pipeline

    long = tricky.union(tricky.limit(1).withColumn("doc_id", F.lit(77).cast("long")).withColumn("text", F.lit("eau que " * 100_000)))
    spark.createDataFrame([(4, 0), (5, 1), (9, 0), (None, 1)], "doc_id long, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, long, f"file://{tmp_path}")
        assert out.columns == tricky.columns, name
        assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in long.collect()}, name
        assert stage(spark, empty, f"file://{tmp_path}").count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, empty, f"file://{tmp_path}").count() == 0


def test_near_duplicates_query_by_brute_force(spark, tmp_path):
    rng = random.Random(21)
    base = [[f"w{rng.randrange(300)}" for _ in range(rng.randint(3, 200))] for _ in range(40)]
    texts = [" ".join(b) for b in base] + [" ".join(b[:-1] + ["new"]) for b in base if len(b) > 120] + [" ".join(base[k % 40]) for k in range(60)] + [None, "", "a", "A", "x y"]
    rows = list(enumerate(texts, 5))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    fp = {d: brute_simhash(t) for d, t in rows}
    root = {d: d for d in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fp:
        for b in fp:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 2 and find(a) != find(b):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op3_simhash.query(spark, f"file://{tmp_path}").collect()}
    assert got == {d: (f"{f:016x}", find(d)) for d, f in fp.items()}
