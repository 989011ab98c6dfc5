import collections
import itertools
import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillcube.config import Config, Event
from skillcube.functions import columns as C
from skillcube.jobs import evaluate
from skillcube.operators import forecasts, metrics

SCHEMA = "variable string, lead int, lat double, lon double, init int, members array<double>, truth double"


def points(spark, members, truth, lat=0.0):
    rows = [("t", 1, lat, 0.0, i, [None if x is None else float(x) for x in m], None if y is None else float(y)) for i, (m, y) in enumerate(zip(members, truth))]
    return spark.createDataFrame(rows, SCHEMA)


def crps(spark, members, truth, fair=False):
    return [r[0] for r in points(spark, members, truth).select(metrics.crps(F.col("members"), F.col("truth"), fair)).collect()]


def test_crps_by_hand(spark):
    assert crps(spark, [[2] * 8], [2]) == [0.0]
    assert crps(spark, [[0.5], [-1], [3], [1]], [1, -2, 3, 0]) == [0.5, 1.0, 0.0, 1.0]
    assert crps(spark, [[1, 9]], [6]) == [2.0] and crps(spark, [[1, 9]], [6], fair=True) == [0.0]
    assert crps(spark, [[1, None], [1, 2], []], [0, None, 1]) == [None, None, None]


def test_crps_equals_pairs(spark):
    x, y = np.random.default_rng(0).normal(size=(60, 7)), np.random.default_rng(1).normal(size=60)
    for fair in (False, True):
        pairs = np.abs(x[:, :, None] - x[:, None, :]).sum((1, 2)) / (7 * 6 if fair else 49)
        assert np.allclose(crps(spark, x, y, fair), np.abs(x - y[:, None]).mean(1) - 0.5 * pairs, atol=1e-12)


def test_calibrated_beats_collapsed(spark):
    r = np.random.default_rng(2)
    y, x = r.normal(size=500), r.normal(size=(500, 8))
    assert np.mean(crps(spark, x, y, True)) < np.mean(crps(spark, np.repeat(x[:, :1] * 0, 8, 1) + 1.5, y, True))


def test_fair_loss_needs_two_members(spark):
    with pytest.raises(Exception, match="two members"):
        metrics.fair_crps_loss(points(spark, [[1]], [1])).collect()


def test_skill(spark):
    r = np.random.default_rng(31)
    model, ref = r.gamma(2.0, size=40), r.gamma(3.0, size=40)
    rows = [*zip(model.tolist(), ref.tolist()), (1.0, 0.0), (1.0, float("nan")), (1.0, float("inf")), (1.0, None), (None, 1.0)]
    got = [x[0] for x in spark.createDataFrame(rows, "m double, r double").coalesce(1).select(metrics.skill(F.col("m"), F.col("r"))).collect()]
    assert np.allclose(got[:40], (ref - model) / ref) and got[40:] == [None] * 5


def test_pair_scores(spark):
    f, o, lat = [1.0, 2.0, -1.0, 3.0, -2.0, None], [1.0, 2.0, -1.0, 3.0, -2.0, 5.0], [0.0, 0.0, 60.0, 60.0, 60.0, 60.0]
    df = spark.createDataFrame([("t", 1, a, b, c) for a, b, c in zip(f, o, lat)], "variable string, lead int, f double, o double, lat double")
    r = metrics.pair_scores(df).first()
    assert r["acc"] == pytest.approx(1.0) and r["rmse"] == 0.0
    e = metrics.pair_scores(df.withColumn("o", F.col("o") + F.when(F.col("lat") == 0, 1.0).otherwise(2.0)), "plain").first()
    assert e["rmse"] == pytest.approx(math.sqrt((2 * 1 + 3 * 4 * math.cos(math.radians(60))) / 5))
    n = metrics.pair_scores(df.withColumn("o", F.col("o") + F.when(F.col("lat") == 0, 1.0).otherwise(2.0))).first()
    assert n["rmse"] == pytest.approx(e["rmse"] / math.sqrt(0.75))


def test_rank_histogram_ties_and_bins(spark):
    h = {r["rank"]: r["count"] for r in metrics.rank_histogram(points(spark, [[1, 2, 3], [2, 2, 5], [1, None, 2]], [2.5, 2, 0])).collect()}
    assert h == {0: pytest.approx(1 / 3), 1: pytest.approx(1 / 3), 2: pytest.approx(4 / 3), 3: 0.0}


def test_rank_histogram_equals_all_tie_breaks(spark):
    """Each order of the truth among the members it ties with is as likely as another."""
    r = np.random.default_rng(77)
    x, y = r.integers(0, 6, (90, 4)).astype(float), r.integers(-1, 7, 90).astype(float)
    want = np.zeros(5)
    for m, t in zip(x, y):
        ranks = [k for k in range(5) if (m < t).sum() <= k <= (m <= t).sum()]
        want[ranks] += 1 / len(ranks)
    got = {g["rank"]: g["count"] for g in metrics.rank_histogram(points(spark, x, y)).collect()}
    assert np.allclose([got[k] for k in range(5)], want) and sum(got.values()) == pytest.approx(90)


def test_spread_error_equals_numpy(spark):
    for m, seed in ((2, 5), (9, 6)):
        r = np.random.default_rng(seed)
        x, y = r.gamma(1.5, size=(33, m)), r.gamma(1.5, size=33)
        want = math.sqrt((m + 1) / m * x.var(1, ddof=1).mean()) / math.sqrt(((x.mean(1) - y) ** 2).mean())
        assert metrics.spread_error(points(spark, x, y)).first()["spread_error_ratio"] == pytest.approx(want)
    assert metrics.spread_error(points(spark, [[4], [7]], [1, 1])).first()["spread_error_ratio"] == 0.0  # no variance with one member
    assert metrics.spread_error(points(spark, [[3, 3]], [3])).first()["spread_error_ratio"] is None  # no error


def test_event_probability_equals_counts(spark):
    r = np.random.default_rng(12)
    x = [[None if r.random() < 0.2 else round(float(v), 1) for v in row] for row in r.normal(size=(25, 7))]
    df = points(spark, x, [0] * 25).orderBy("init")
    for bar in (0.0, 0.7):
        got = df.select(metrics.event_probability(F.col("members"), bar), metrics.event_probability(F.col("members"), bar, "lt")).collect()
        for row, (gt, lt) in zip(x, got):
            assert gt == pytest.approx(sum(v is not None and v > bar for v in row) / 7) and lt == pytest.approx(sum(v is not None and v < bar for v in row) / 7)
    with pytest.raises(ValueError):
        metrics.event_probability(F.col("members"), 1.0, "ge")


def test_event_points_in_both_spaces(spark):
    rows = points(spark, [[0.5, -1, 2], [-3, None, -1]], [1, -2]).union(points(spark, [[9, 9, 9]], [None]))
    physical = rows.withColumn("members", F.transform("members", lambda x: x + 10)).withColumn("truth", F.col("truth") + 10)
    events = [Event("up", "t"), Event("down", "t", comparison="lt", threshold=-1.5), Event("hot", "t", "physical", "gt", 10.4), Event("other", "u", "physical")]
    got = collections.defaultdict(set)
    for r in metrics.event_points(rows, physical, events).collect():
        got[r["event"]].add((round(r["p"], 3), r["y"]))
    assert got == {"up": {(0.667, 1.0), (0.0, 0.0)}, "down": {(0.0, 0.0), (0.333, 1.0)}, "hot": {(0.667, 1.0), (0.0, 0.0)}}
    with pytest.raises(ValueError, match="physical"):
        metrics.event_points(rows, None, events)
    with pytest.raises(ValueError, match="no events"):
        metrics.event_points(rows, None, [])


def test_scores_in_one_pass_equal_the_single_ones(spark):
    r = np.random.default_rng(4)
    rows = [(v, l, lat, 0.0, i, [None if r.random() < 0.03 else float(x) for x in r.normal(size=5)], None if r.random() < 0.1 else float(r.normal())) for v in "ab" for l in (1, 2) for lat in (-30.0, 10.0, 50.0) for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(x["variable"], x["lead"]): x for x in evaluate.model_scores(df, Config()).collect()}
    m, t = F.col("members"), F.col("truth")
    each = df.withColumn("crps", metrics.crps(m, t, True)).withColumn("zero", F.abs(t)).withColumn("f", metrics.ensemble_mean(m)).withColumn("o", t)
    single = {"crps_model": (metrics.spatial_mean(each, "crps"), "mean"), "crps_clim_det": (metrics.spatial_mean(each, "zero"), "mean"), "acc_mean": (metrics.pair_scores(each, "plain"), "acc"), "rmse_mean": (metrics.pair_scores(each, "plain"), "rmse"), "spread_error_ratio": (metrics.spread_error(df), "spread_error_ratio")}
    for name, (table, column) in single.items():
        want = {(x["variable"], x["lead"]): x[column] for x in table.collect()}
        assert len(want) == 4 and all(got[k][name] == pytest.approx(v) for k, v in want.items()), name


def test_reliability_bins_are_linspace_bins(spark):
    p = [i / 10 for i in range(11)]
    df = spark.createDataFrame([("t", 1, x, 1.0) for x in p], "variable string, lead int, p double, y double")
    got = {r["bin"]: r["n"] for r in metrics.reliability_curve(df).collect()}
    want = np.bincount(np.clip(np.digitize(p, np.linspace(0, 1, 11)[1:-1]), 0, 9), minlength=10)
    assert [got[b] for b in range(10)] == want.tolist()
    r = {x["bin"]: x["observed"] for x in metrics.reliability_curve(df.where("p in (0.0, 1.0)").withColumn("y", F.col("p"))).collect()}
    assert r[0] == 0.0 and r[5] is None and r[9] == 1.0


def test_reliability_ranks(spark):
    r = np.random.default_rng(3)
    x, y = r.normal(size=(40, 6)), r.normal(size=40)
    got = {g["nominal"]: g["observed"] for g in metrics.reliability_ranks(points(spark, x, y)).collect()}
    for p in (np.arange(10) + 0.5) / 10:
        assert abs(got[min(got, key=lambda k: abs(k - p))] - np.mean(y <= np.sort(x, 1)[:, min(int(p * 6), 5)])) < 1e-12


def test_gate(spark):
    df = spark.createDataFrame([(3, 0.1), (4, 0.2), (5, -1.0)], "lead int, crpss_vs_prob double")
    assert metrics.gate(df, [3, 4]).first()["passed"] is True
    assert metrics.gate(df, [3, 5]).first()["passed"] is False
    assert metrics.gate(df, [9]).first()["passed"] is False
    assert metrics.gate(df.withColumn("crpss_vs_prob", F.lit(None).cast("double")), [3]).first()["passed"] is False


def test_pools_and_their_scores_by_brute_force(spark):
    r, start = np.random.default_rng(15), date(1997, 12, 29)  # a Monday; the record has a week 53
    weeks = [start + timedelta(weeks=k) for k in range(330)]
    values = [None if r.random() < 0.05 else round(float(r.normal()), 3) for _ in weeks]
    train = spark.createDataFrame([("t", 3, w, v) for w, v in zip(weeks, values) if v is not None], "variable string, cell_id int, week date, value double")
    pool = forecasts.woy_pool(train, 2)
    got = {x["target_woy"]: x["members"] for x in pool.collect()}
    ring = lambda a, b: min(abs(a - b), 52 - abs(a - b))
    want = {k: sorted(v for w, v in zip(weeks, values) if v is not None and ring(w.isocalendar().week, k) <= 2) for k in range(1, 54)}
    assert got == want
    targets = [(w, l, None if r.random() < 0.1 else float(r.normal())) for w in weeks[:80] for l in (1, 6)]
    rows = spark.createDataFrame([("t", 3, 20.0, *x) for x in targets], "variable string, cell_id int, lat double, init date, lead int, truth double")
    for fair in (True, False):
        scored = {(x["init"], x["lead"]): x["crps"] for x in forecasts.with_pool(rows, pool, fair).collect()}
        assert len(scored) == len(targets)
        for w, l, t in targets:
            x = np.array(want[(w + timedelta(weeks=l)).isocalendar().week])
            crps_ = None if t is None else np.abs(x - t).mean() - np.abs(x[:, None] - x).sum() / 2 / (len(x) * (len(x) - 1) if fair else len(x) ** 2)
            assert scored[w, l] == (None if t is None else pytest.approx(crps_))


def test_week_ring(spark):
    df = spark.createDataFrame(list(itertools.product(range(1, 54), [53])), "a int, b int")
    near = {r["a"] for r in df.where(C.week_distance(F.col("a"), F.col("b")) <= 3).collect()}
    assert near == {50, 51, 52, 53, 1, 2, 3, 4}


def test_tile_noise_is_fixed_and_local(spark):
    f = spark.range(2 * 8 * 8).select((F.col("id") % 2).alias("sample"), F.lit("c").alias("channel"), F.floor(F.col("id") / 16).cast("int").alias("lat_idx"), (F.floor(F.col("id") / 2) % 8).cast("int").alias("lon_idx"), F.lit(0.0).alias("value"))
    a = {tuple(r) for r in forecasts.tile_noise(f, [0, 1], 1.0).collect()}
    assert a == {tuple(r) for r in forecasts.tile_noise(f.repartition(7), [0, 1], 1.0).collect()}
    changed = [r for r in forecasts.tile_noise(f, [0, 1], 1.0).where("value <> 0").groupBy("member", "sample").count().collect()]
    assert [r["count"] for r in changed] == [16] * 4
    with pytest.raises(ValueError):
        forecasts.ensemble(f, [], [0], 1.0)


def double(batches, members):
    import pandas as pd

    for pdf in batches:
        yield pd.concat([pdf.assign(member=m, value=pdf["value"] * (m + 1)) for m in range(members)])


def test_member_sources(spark):
    f = spark.createDataFrame([(s, "c", i, j, float(s + i + j)) for s in range(6) for i in range(4) for j in range(4)], "sample int, channel string, lat_idx int, lon_idx int, value double")
    schema, cfg = f.withColumn("member", F.lit(0)).schema, Config(members=3)
    inner = forecasts.members_of(f, cfg, schema, noisy=double)
    assert {r["member"]: r["s"] for r in inner.groupBy("member").agg(F.sum("value").alias("s")).collect()} == {m: (m + 1) * f.agg(F.sum("value")).first()[0] for m in range(3)}
    outer = forecasts.members_of(f, cfg, schema, predictors=[lambda x: x, lambda x: x.withColumn("value", -F.col("value"))])
    signs = {r["member"]: r["s"] > 0 for r in outer.groupBy("member").agg(F.sum("value").alias("s")).collect()}
    assert signs == {0: True, 1: False, 2: True}
    for bad in (dict(cfg=cfg.with_(member_source="internal")), dict(cfg=cfg.with_(member_source="odd")), dict(cfg=cfg), dict(cfg=cfg.with_(members=0), noisy=double)):
        with pytest.raises(ValueError):
            forecasts.members_of(f, schema=schema, **bad)
