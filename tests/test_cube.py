from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillcube.config import PRECIPITATION, Config, Splits
from skillcube.functions import columns as C
from skillcube.jobs import build
from skillcube.operators import climatology, geometry, splits, windows
from skillcube.sources import cube

CUBE = "variable string, cell_id int, lat double, lon double, time date, value double"


def series(spark, values, start=date(2010, 1, 1), variable="t", cell=0):
    return spark.createDataFrame([(variable, cell, 0.0, 0.0, start + timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)], CUBE)


@pytest.fixture(scope="module")
def record(spark):
    days = (date(2020, 12, 31) - date(1979, 1, 1)).days + 1
    base = spark.range(days).select(F.date_add(F.lit(date(1979, 1, 1)), F.col("id").cast("int")).alias("time"))
    value = 280 + 10 * F.sin(2 * np.pi * F.dayofyear("time") / 365.25) + C.gaussian(F.lit(0), F.col("time"), F.col("variable")) * 0.5
    rows = base.withColumn("variable", F.explode(F.array(F.lit("2m_temperature"), F.lit(PRECIPITATION)))).withColumn("value", F.when(F.col("variable") == PRECIPITATION, F.abs(value - 280)).otherwise(value))
    return rows.select("variable", F.lit(0).alias("cell_id"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), "time", "value").cache()


SPLITS = Splits((1979, 2012), (2013, 2017), (2018, 2020))


def test_embargo_and_disjoint(record):
    t = splits.tagged(record, SPLITS)
    ends = {r["split"]: (r["lo"], r["hi"]) for r in t.groupBy("split").agg(F.min("time").alias("lo"), F.max("time").alias("hi")).collect()}
    assert (ends["val"][0] - ends["train"][1]).days >= 28 and (ends["test"][0] - ends["val"][1]).days >= 28
    assert ends["test"][1] == date(2020, 12, 31)
    n = {r["split"]: r["days"] for r in splits.census(t).collect()}
    assert n["train"] == 12391 and n["val"] == 1798


def test_statistics_come_from_train_only(record):
    t = splits.tagged(record, SPLITS)
    broken = t.withColumn("value", F.when(F.col("split") == "train", F.col("value")).otherwise(9999.0))
    a, b = climatology.fit(t, 11), climatology.fit(broken, 11)
    assert a.exceptAll(b).count() == 0 and a.count() == 2 * 366
    na = {r["variable"]: r["std"] for r in climatology.normalizer(climatology.anomaly(t, a)).collect()}
    nb = {r["variable"]: r["std"] for r in climatology.normalizer(climatology.anomaly(broken, b)).collect()}
    assert na == nb


def test_sample_counts(record):
    t = splits.tagged(record.where("variable = '2m_temperature'"), SPLITS)
    train = windows.daily_windows(windows.daily_spine(splits.only(t, "train")), 2, range(1, 7))
    val = windows.daily_windows(windows.daily_spine(splits.only(t, "val")), 2, range(1, 7))
    assert (train.count(), val.count()) == (12330, 1737)
    weekly = windows.weekly_windows(windows.weekly_spine(windows.weekly_mean(splits.only(t, "train"))), 2, range(1, 7))
    assert weekly.count() == 1764


def test_week_edges(spark):
    w = {r["week"]: r["value"] for r in windows.weekly_mean(series(spark, range(11), date(2010, 1, 7))).collect()}  # a Thursday
    assert w == {date(2010, 1, 4): 1.5, date(2010, 1, 11): 7.0}
    assert windows.weekly_mean(series(spark, range(11), date(2010, 1, 7)), min_days=7).count() == 1


def test_circular_smoothing(spark):
    rows = spark.createDataFrame([("t", 0, d, float(d)) for d in range(1, 366)], "variable string, cell_id int, doy int, raw double")
    got = {r["doy"]: r["clim"] for r in climatology.smooth(rows, 11).collect()}
    assert len(got) == 365 and got[100] == 100.0
    assert got[1] == pytest.approx(np.mean([361, 362, 363, 364, 365, 1, 2, 3, 4, 5, 6]))
    even = {r["doy"]: r["clim"] for r in climatology.smooth(rows, 4).collect()}
    assert even[100] == np.mean([98, 99, 100, 101])


def test_doy_clamp_and_missing_climatology(spark):
    clim = spark.createDataFrame([("t", 0, d, 1.0) for d in range(1, 366)], "variable string, cell_id int, doy int, clim double")
    leap = series(spark, [5.0], date(2012, 12, 31))
    assert climatology.anomaly(leap, clim).first()["value"] == 4.0
    holes = clim.where("doy <> 3")
    with pytest.raises(Exception, match="no climatology"):
        climatology.anomaly(series(spark, [1.0, 1.0, 1.0]), holes).collect()
    assert [r["value"] for r in climatology.anomaly(series(spark, [1.0, 1.0, 1.0]), holes, "null").orderBy("time").collect()] == [0.0, 0.0, None]


def test_round_trip_to_physical(spark):
    c = splits.tagged(series(spark, [float(i % 7) for i in range(800)], date(1995, 1, 1), PRECIPITATION), Splits((1995, 1996), (1998, 1998), (1999, 1999)))
    b = build.build(c.drop("split"), Config(splits=Splits((1995, 1996), (1998, 1998), (1999, 1999))))
    back = climatology.physical(climatology.destandardize(climatology.standardize(b.anomalies, b.norm), b.norm), b.climatology)
    both = back.join(c.select("time", F.col("value").alias("was")), "time").agg(F.max(F.abs(F.col("physical") - F.col("was"))).alias("e"), F.count(F.lit(1)).alias("n")).first()
    assert both["n"] > 600 and both["e"] < 1e-9


def test_zero_spread_is_scaled_by_one(spark):
    norm = spark.createDataFrame([("t", 2.0, 0.0)], "variable string, mean double, std double")
    z = climatology.standardize(series(spark, [5.0]), norm)
    assert z.first()["value"] == 3.0 and climatology.destandardize(z, norm).first()["value"] == 5.0


def test_rolling_needs_seven(spark):
    s = series(spark, [float(i) for i in range(30)]).where("time not in (DATE '2010-01-11', DATE '2010-01-12', DATE '2010-01-13')")
    got = {r["time"].toordinal() - date(2010, 1, 1).toordinal(): r["rolled"] for r in windows.rolling7(windows.daily_spine(s)).collect()}
    assert len(got) == 30 and got[6] == 3.0 and got[9] == 6.0
    assert all(got[d] is None for d in [*range(6), *range(10, 19)]) and got[19] == 16.0


def test_daily_window_offsets(spark):
    w = windows.daily_windows(windows.daily_spine(series(spark, [float(i) for i in range(70)])), 2, [1, 3]).orderBy("init")
    first = w.first()
    t = (first["init"] - date(2010, 1, 1)).days
    assert t == 13 and first["history"] == [t - 10.0, t - 3.0] and first["targets"] == [t + 10.0, t + 24.0]
    assert w.count() == 70 - 7 * 3 - 7 - 13 + 1
    assert windows.daily_windows(windows.daily_spine(series(spark, [1.0] * 20)), 2, [1, 3]).count() == 0


def test_windows_do_not_cross_splits(spark):
    s = series(spark, [float(i) for i in range(140)]).withColumn("split", F.when(F.col("time") < "2010-03-12", "train").otherwise("val"))
    w = windows.daily_windows(windows.daily_spine(s), 2, [1])
    top = w.where("split = 'train'").agg(F.max(F.array_max("targets"))).first()[0]
    assert top <= 69 and w.where("split = 'val'").agg(F.min(F.array_min("history"))).first()[0] >= 70


def test_lead_targets_and_valid_inits(spark):
    s = windows.weekly_spine(windows.weekly_mean(series(spark, [float(i // 7) for i in range(70)], date(2010, 1, 4))))
    got = {(r["init"], r["lead"]): r["truth"] for r in windows.lead_targets(s, [1, 2]).collect()}
    assert got[date(2010, 1, 4), 2] == 2.0 and got[date(2010, 3, 8), 1] is None
    assert windows.valid_inits(s, 3).count() == 7 and windows.valid_inits(s, 0).count() == 10


def test_channels_and_packing(spark):
    cfg = Config(lead_weeks=(1, 2, 3))
    assert cfg.channels == (13, 2) and cfg.input_vars[:2] == cfg.targets and cfg.input_vars[-1] == "u_component_of_wind_200"
    rows = [(v, c, float(c), 0.0, date(2010, 1, 4) + timedelta(weeks=w), None if (v, w) == (PRECIPITATION, 0) else 100.0 * i + 10 * w + c) for i, v in enumerate(cfg.input_vars) for c in range(3) for w in range(10)]
    spine = spark.createDataFrame(rows, "variable string, cell_id int, lat double, lon double, week date, value double")
    s = windows.samples(windows.weekly_windows(spine, 2, cfg.lead_weeks), cfg).orderBy("init").collect()
    assert len(s) == 10 - 1 - 3 and len(s[0]["input"]) == 13 * 3 and len(s[0]["target"]) == 3 * 2 * 3
    assert s[0]["input"][:6] == [0.0, 1.0, 2.0, 0.0, 0.0, 0.0] and s[0]["input"][18:21] == [10.0, 11.0, 12.0]
    assert s[0]["target"][:3] == [20.0, 21.0, 22.0] and s[0]["target"][3:6] == [120.0, 121.0, 122.0]
    assert s[0]["input"][-1] == pytest.approx(np.cos(2 * np.pi * 11 / 365.25), abs=1e-6)


def test_verify(spark):
    g = geometry.lonlat_grid(spark, 45.0).select("cell_id", "lat", "lon")
    t = spark.range(6).select(F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_interval(0, 0, 0, 0, 6 * cast(id as int))").alias("time"))
    c = g.crossJoin(t).select(F.lit("2m_temperature").alias("variable"), "cell_id", "lat", "lon", "time", F.lit(280.0).alias("value"))
    assert cube.verify(c, 4, 8).first()["n"] == 4 * 8 * 6
    for bad, why in ((c.where("lat > 0"), "grid"), (c.where(F.col("time") != datetime(2020, 1, 1, 12)), "steps"), (c.withColumn("value", F.lit(1000.0)), "runs from")):
        with pytest.raises(ValueError, match=why):
            cube.verify(bad, 4, 8)


def test_sources(spark, tmp_path):
    c = series(spark, [1.0, float("nan"), 3.0])
    assert cube.clean(c).agg(F.avg("value")).first()[0] == 2.0
    with pytest.raises(KeyError):
        cube.require(c, ["t", "u"])
    lev = spark.createDataFrame([("z", 500, 1.0), ("z", 850, 2.0), ("u", 850, 3.0)], "variable string, level int, value double")
    assert {r["variable"] for r in cube.flatten_levels(lev, [("z", (500,)), ("u", (850,))]).collect()} == {"z_500", "u_850"}
    with pytest.raises(FileNotFoundError):
        cube.read_cube(spark, str(tmp_path / "none"))
    cube.write_cube(splits.tagged(c, Splits((2010, 2010), (2011, 2011), (2012, 2012))), str(tmp_path / "c"))
    assert cube.read_cube(spark, str(tmp_path / "c"), split="train").count() == 3
    assert cube.years(series(spark, [0.0] * 800), (2011, 2011)).count() == 365


def test_geometry(spark):
    g = geometry.lonlat_grid(spark).agg(F.count(F.lit(1)), F.min("lat"), F.max("lat"), F.max("lon")).first()
    assert tuple(g) == (2048, -87.1875, 87.1875, 354.375)
    m = geometry.healpix(spark, 16)
    assert m.count() == 3072
    x = m.agg(F.avg(F.sin(F.radians("lat"))), F.avg(F.cos(F.radians("lat")) * F.cos(F.radians("lon"))), F.countDistinct(F.round("lat", 9), F.round("lon", 9)), F.avg(F.pow(F.sin(F.radians("lat")), 2))).first()
    assert abs(x[0]) < 1e-12 and abs(x[1]) < 1e-12 and x[2] == 3072 and x[3] == pytest.approx(1 / 3, abs=1e-3)
    base = [tuple(r) for r in geometry.healpix(spark, 1).orderBy("pix").select(F.round("lon", 6), F.round("lat", 6)).collect()]
    assert base[:5] == [(45.0, 41.810315), (135.0, 41.810315), (225.0, 41.810315), (315.0, 41.810315), (0.0, 0.0)]
    with pytest.raises(ValueError):
        geometry.healpix(spark, 24)


def test_nested_children_are_near_their_parent(spark):
    child = geometry.healpix(spark, 8).withColumn("parent", geometry.coarser(F.col("pix"), 4))
    par = geometry.healpix(spark, 4).select(F.col("pix").alias("parent"), F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    far = child.join(par, "parent").agg(F.max(C.haversine(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon")))).first()[0]
    assert far < np.radians(12)


def test_interpolation(spark):
    pts = geometry.lonlat_grid(spark, 11.25).select(F.col("cell_id").alias("id"), "lon", "lat")
    mesh = geometry.healpix(spark, 8).withColumnRenamed("pix", "id")
    flat = geometry.round_trip(pts, mesh, pts.select("id", F.lit(-17.25).alias("value")))
    assert flat.agg(F.max(F.abs(F.col("value") + 17.25))).first()[0] < 1e-9
    loss = {(r["nside"], r["name"]): r["relative"] for r in geometry.loss_by_resolution(pts, spark, (4, 8)).collect()}
    assert loss[8, "wave_k3"] <= loss[4, "wave_k3"] < 0.2 and loss[8, "wave_k3"] < loss[8, "noise"]


def angles(a, b):
    """Great-circle angles between rows of (lon, lat) in degrees."""
    u, v = (np.stack([np.cos(np.radians(p[:, 1])) * np.cos(np.radians(p[:, 0])), np.cos(np.radians(p[:, 1])) * np.sin(np.radians(p[:, 0])), np.sin(np.radians(p[:, 1]))], 1) for p in (a, b))
    return np.arccos(np.clip(u @ v.T, -1, 1))


@pytest.mark.parametrize("n,k,few", [(3, 5, None), (40, 3, True), (900, 8, None), (3, 5, False), (40, 3, False), (900, 8, False)])
def test_neighbours_by_brute_force(spark, n, k, few):
    """Even and clustered points, points at the poles and across the date line, fewer points than asked for."""
    r = np.random.default_rng(n)
    src = np.column_stack([r.uniform(0, 360, n), np.degrees(np.arcsin(r.uniform(-1, 1, n)))])
    src[: n // 3] = [[77.0, 28.0]] + r.normal(0, 0.05, (n // 3, 2))
    to = np.vstack([np.column_stack([r.uniform(-180, 180, 60), r.uniform(-90, 90, 60)]), src[:5], [[0, 90], [123, -90], [359.99, 0], [77.0, 28.0]]])
    frame = lambda p: spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, lon double, lat double")
    got = {}
    for row in geometry.knn(frame(src), frame(to), k, few).collect():
        got.setdefault(row["to_id"], {})[row["rank"]] = (row["from_id"], row["dist"])
    want = angles(to, src)
    for i in range(len(to)):
        assert sorted(got[i]) == list(range(1, min(k, n) + 1))
        best = np.sort(want[i])[:k]
        assert np.allclose([got[i][j + 1][1] for j in range(len(best))], best, atol=1e-7)
        assert len({f for f, _ in got[i].values()}) == len(best)


def test_far_neighbours_are_not_all_looked_at(spark):
    """Sources on one side and targets on the other: each target meets a few of the sources, and copies at one place are no more than k."""
    r = np.random.default_rng(0)
    src = np.column_stack([r.uniform(60, 100, 3_000), r.uniform(5, 40, 3_000)])
    src[:400] = [100.0, 40.0]
    to = np.column_stack([r.uniform(180, 330, 40), r.uniform(-60, 60, 40)])
    frame = lambda p: spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, lon double, lat double")
    pairs = geometry._from_above(frame(src[400:]), frame(to).withColumnRenamed("id", "to_id"), 4)
    assert pairs.count() < 40 * 2_600 / 50
    got = {}
    for row in geometry.knn(frame(src), frame(to), 4, few=False).collect():
        got.setdefault(row["to_id"], {})[row["rank"]] = (row["dist"], row["from_id"])
    want = angles(to, src)
    for i in range(40):
        order = np.lexsort((np.arange(3_000), np.round(want[i], 9)))[:4]
        assert np.allclose([got[i][j + 1][0] for j in range(4)], want[i][order], atol=1e-7)
        if order[0] < 400:
            assert [got[i][j + 1][1] for j in range(4)] == [0, 1, 2, 3]


def test_published_loss_of_the_full_grid(spark):
    """The waves' round-trip error over their range in the evaluation box, on the 5.625-degree grid."""
    pts = geometry.points_of(spark, None)
    loss = {(r["nside"], r["name"]): r["relative"] for r in geometry.loss_by_resolution(pts, spark, (16, 32), 8, Config().box).where("name <> 'noise'").collect()}
    assert all(0.006 < loss[16, w] < 0.030 for w in ("wave_k3", "wave_k6")) and all(0.0015 < loss[32, w] < 0.010 for w in ("wave_k3", "wave_k6"))


def holed(spark, cells=3, days=400, start=date(2010, 1, 1)):
    """A cube of two variables in which one variable lacks a cell altogether."""
    rows = [(v, c, float(c), 0.0, start + timedelta(days=d), 100.0 * i + c + d / 1000) for i, v in enumerate(("2m_temperature", PRECIPITATION)) for c in range(cells) for d in range(days) if (i, c) != (1, 1)]
    return spark.createDataFrame(rows, CUBE)


SMALL = Config(surface_predictors=(), level_predictors=(), lead_weeks=(1, 2), splits=Splits((2010, 2010), (2011, 2011), (2012, 2012)))


def test_samples_keep_their_shape(spark):
    z = splits.tagged(holed(spark), SMALL.splits)
    norm = spark.createDataFrame([(v, 0.0, 1.0) for v in SMALL.targets], "variable string, mean double, std double")
    s = build.samples(z, norm, SMALL, "train").orderBy("init").collect()
    assert {len(r["input"]) for r in s} == {(2 * 2 + 1) * 3} and {len(r["target"]) for r in s} == {2 * 2 * 3}
    first = s[0]["input"]
    assert [round(x) for x in first[:3]] == [0, 1, 2] and [round(x) for x in first[3:6]] == [100, 0, 102]  # the lacking cell is 0 in its place
    assert s[0]["target"][4] is None and s[0]["target"][3] is not None
    packed = windows.samples(windows.daily_windows(windows.daily_spine(splits.only(z, "train")), 2, (1, 2)), SMALL)
    with pytest.raises(Exception, match="series missing"):
        packed.collect()


def test_short_blocks_and_leaks_are_refused(spark):
    z = splits.tagged(holed(spark, days=730 + 10), SMALL.splits)
    norm = spark.createDataFrame([(v, 0.0, 1.0) for v in SMALL.targets], "variable string, mean double, std double")
    with pytest.raises(ValueError, match="steps"):
        build.samples(z, norm, SMALL, "test")
    w = windows.daily_windows(windows.daily_spine(splits.only(z, "train"), SMALL.input_vars), 2, (1, 2))
    assert windows.inside_blocks(w, SMALL.splits, 13, 20).count() == w.count() > 0
    with pytest.raises(Exception, match="beyond its block"):
        windows.inside_blocks(w.withColumn("init", F.date_add("init", 1)), SMALL.splits, 13, 20).collect()


def test_sample_order_and_batches(spark):
    s = spark.range(50).select(F.date_add(F.lit("2010-01-01").cast("date"), F.col("id").cast("int")).alias("init"), F.lit("x").alias("input"))
    place = lambda d: {r["init"]: r["place"] for r in d.collect()}
    a = place(build.shuffled(s, 3))
    assert sorted(a.values()) == list(range(50)) and a == place(build.shuffled(s.repartition(7), 3))
    assert a != place(build.shuffled(s, 4)) and a != place(build.shuffled(s, 3, epoch=1))
    sizes = {r["batch"]: r["count"] for r in build.batches(build.shuffled(s, 3), 16).groupBy("batch").count().collect()}
    assert sizes == {0: 16, 1: 16, 2: 16, 3: 2}


def test_commands(spark, tmp_path):
    """From a stored cube to scores, histograms, curves and the gate of a stored forecast."""
    from skillcube.jobs import cli

    days = spark.range(6 * 366).select(F.date_add(F.lit("2005-01-01").cast("date"), F.col("id").cast("int")).alias("time")).where("time < '2011-01-01'")
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("cell_id"), F.lit(10.0 * i).alias("lat"), F.lit(70.0 + i).alias("lon")) for i in range(3)])).alias("c")
    rows = days.select("time", cells).select("time", "c.*", F.explode(F.array(F.lit("2m_temperature"), F.lit(PRECIPITATION))).alias("variable"))
    noise = C.gaussian(F.lit(1), F.col("time"), F.col("cell_id"), F.col("variable"))
    value = F.when(F.col("variable") == PRECIPITATION, F.abs(noise) / 50).otherwise(300 + noise * 8)
    rows.select("variable", "cell_id", "lat", "lon", F.col("time").cast("timestamp").alias("time"), value.alias("value")).write.parquet(str(tmp_path / "cube"))
    (tmp_path / "cfg.json").write_text('{"surface_predictors": [], "level_predictors": [], "lead_weeks": [1, 2], "gate_leads": [1], "splits": {"train": [2005, 2008], "val": [2009, 2009], "test": [2010, 2010]}, "box": {"lat_min": 5.0, "lat_max": 40.0, "lon_min": 65.0, "lon_max": 100.0}}')
    base = ["--settings", str(tmp_path / "cfg.json"), "--out"]
    with pytest.raises(ValueError, match="grid is 3 x 3"):
        cli.main(["build", "--cube", str(tmp_path / "cube"), *base, str(tmp_path / "data")])
    cli.main(["build", "--cube", str(tmp_path / "cube"), *base, str(tmp_path / "data"), "grid=[3,3]", "step_hours=24"])
    cli.main(["baselines", "--data", str(tmp_path / "data"), *base, str(tmp_path / "base")])
    table = spark.read.csv(str(tmp_path / "base/baselines"), header=True, inferSchema=True).collect()
    assert [(r["variable"], r["lead_week"]) for r in table] == [(v, k) for v in ("2m_temperature", PRECIPITATION) for k in (1, 2)]
    cli.main(["samples", "--data", str(tmp_path / "data"), "--split", "test", *base, str(tmp_path / "samples")])
    assert spark.read.parquet(str(tmp_path / "samples")).agg(F.max(F.size("input"))).first()[0] == 15
    b = build.load(spark, str(tmp_path / "data"))
    z = climatology.standardize(windows.weekly_mean(splits.only(b.anomalies, "test")), b.norm)
    spread = F.explode(F.array(*[F.struct(F.lit(l).alias("lead"), F.lit(m).alias("member"), (C.gaussian(F.lit(m), F.col("week"), F.col("cell_id"), F.col("variable"), F.lit(l)) / 3).alias("value")) for l in (1, 2) for m in range(6)])).alias("f")
    z.select("variable", "cell_id", "lat", "lon", F.col("week").alias("init"), spread).select("variable", "cell_id", "lat", "lon", "init", "f.*").write.parquet(str(tmp_path / "forecast"))
    cli.main(["evaluate", "--data", str(tmp_path / "data"), "--forecast", str(tmp_path / "forecast"), *base, str(tmp_path / "results")])
    read = lambda name: spark.read.csv(str(tmp_path / "results" / name), header=True, inferSchema=True)
    scores = read("scores").collect()
    assert len(scores) == 4 and all(r["crps_model"] > 0 and r["crpss_vs_det"] is not None for r in scores)
    assert read("rank_histogram").groupBy("variable", "lead").count().where("count <> 7").count() == 0
    assert {r["event"] for r in read("event_reliability").collect()} == {"t2m_anom_positive", "precip_anom_positive", "extreme_heat_40C", "heavy_rain_50mm"}
    assert read("gate").count() == 1
    with pytest.raises(FileNotFoundError):
        cli.main(["baselines", "--data", str(tmp_path / "nowhere"), *base, str(tmp_path / "x")])
    with pytest.raises(SystemExit):
        cli.main(["evaluate", "--data", str(tmp_path / "data"), *base, str(tmp_path / "x")])
