"""Cross-validation, streams, stored weights, fits and their commands, missing values in scores."""

import datetime as dt
import math
import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillcube.config import PRECIPITATION, Box, Config, Splits
from skillcube.functions import columns as C
from skillcube.jobs import build, cli, evaluate, fit
from skillcube.jobs import study as registered
from skillcube.operators import climatology, crossval, metrics, splits
from skillcube.sources import weights, zarr
from skillcube.streaming import weekly

CFG = Config(surface_predictors=(), level_predictors=(), lead_weeks=(1, 2), gate_leads=(1,), splits=Splits((2005, 2007), (2008, 2008), (2009, 2009)), box=Box(-5.0, 40.0, 0.0, 360.0), train_stride_days=9, members=6, grid=(2, 2), step_hours=24)


def cube_of(spark, cells=4):
    days = spark.range(5 * 366).select(F.date_add(F.lit("2005-01-01").cast("date"), F.col("id").cast("int")).alias("time")).where("time < '2010-01-01'")
    places = F.explode(F.array(*[F.struct(F.lit(i).alias("cell_id"), F.lit(20.0 * (i // 2)).alias("lat"), F.lit(70.0 + i % 2).alias("lon")) for i in range(cells)])).alias("c")
    rows = days.select("time", places).select("time", "c.*", F.explode(F.array(F.lit("2m_temperature"), F.lit(PRECIPITATION))).alias("variable"))
    noise = C.gaussian(F.lit(1), F.col("time"), F.col("cell_id"), F.col("variable"))
    slow = C.gaussian(F.lit(2), F.trunc("time", "month"), F.col("cell_id"), F.col("variable"))
    value = F.when(F.col("variable") == PRECIPITATION, F.abs(noise + slow) / 50).otherwise(300 + noise * 3 + 6 * slow)
    return rows.select("variable", "cell_id", "lat", "lon", "time", value.alias("value"))


@pytest.fixture(scope="module")
def study(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('study')}"
    built = build.build(cube_of(spark), CFG)
    build.write(built, path)
    built.release()
    built = build.load(spark, path)
    data = build.data(built, CFG)
    stored = {}
    for name in ("train", "val", "test"):
        getattr(data, name).write.parquet(f"{path}/samples-{name}")
        stored[name] = spark.read.parquet(f"{path}/samples-{name}")
    return built, build.Data(data.cell_id, data.lat, data.lon, data.target_vars, data.channels, data.norm, **stored)


def test_data_holder(study):
    _, data = study
    assert data.grid == (2, 2) and data.channels == (5, 2) and data.cell_id.tolist() == [0, 1, 2, 3] and data.lon.tolist() == [70, 71, 70, 71]
    assert np.allclose(data.cell_weights(), np.cos(np.radians([0, 0, 20, 20])) / np.cos(np.radians([0, 20])).mean())
    for s in (data.train, data.val, data.test):
        assert s.where(f"size(input) <> {5 * 4} or size(target) <> {2 * 2 * 4}").count() == 0 and s.count() > 30
    assert {r["variable"] for r in data.norm.collect()} == set(data.target_vars)


def arrays(samples, data):
    rows = sorted(samples.collect(), key=lambda r: str(r["init"]))
    x = np.array([r["input"] for r in rows]).reshape(len(rows), -1, 4)
    return x, np.array([[np.nan if v is None else v for v in r["target"]] for r in rows]).reshape(len(rows), -1, 4)


def test_gradients_equal_numpy(study):
    _, data = study
    rng = np.random.default_rng(0)
    params = {"weight": rng.normal(size=(4, 5)), "bias": rng.normal(size=4)}
    loss, n, g = fit.gradients(data.val, params, data.cell_weights(), fit.FitConfig(), 0)
    x, y = arrays(data.val, data)
    w = data.cell_weights()
    e = np.einsum("oi,sic->soc", params["weight"], x) + params["bias"][:, None] - y
    assert n == np.isfinite(y).sum() and np.isclose(loss, np.nansum(e * e * w) / n)
    assert np.allclose(g["weight"], np.einsum("soc,sic->oi", np.nan_to_num(2 * e * w), x) / n) and np.allclose(g["bias"], np.nansum(2 * e * w, (0, 2)) / n)


def test_crps_gradient_is_the_slope():
    rng = np.random.default_rng(1)
    params = {"weight": rng.normal(size=(3, 2)), "bias": rng.normal(size=3), "spread": rng.normal(size=3) / 3}
    x, y, w, draws = rng.normal(size=(2, 6)), rng.normal(size=(3, 6)), rng.uniform(0.5, 1.5, 6), rng.normal(size=(5, 3, 6))
    y[0, 0] = np.nan
    loss, n, g = fit.crps_gradient(params, x, y, w, draws)
    members = params["weight"] @ x + params["bias"][:, None] + np.exp(params["spread"])[:, None] * draws
    pairs = np.abs(members[:, None] - members[None]).sum((0, 1)) / (2 * 5 * 4)
    assert n == 17 and np.isclose(loss, np.nansum((np.abs(members - y).mean(0) - pairs) * w))
    for name, p in params.items():
        for i in np.ndindex(p.shape):
            near = [{**params, name: p + s * 1e-6 * (np.arange(p.size).reshape(p.shape) == np.ravel_multi_index(i, p.shape))} for s in (1, -1)]
            slope = (fit.crps_gradient(near[0], x, y, w, draws)[0] - fit.crps_gradient(near[1], x, y, w, draws)[0]) / 2e-6
            assert abs(slope - g[name][i]) < 1e-4
    with pytest.raises(ValueError):
        fit.started(CFG, fit.FitConfig(loss=fit.CRPS, train_members=1))
    with pytest.raises(ValueError):
        fit.started(CFG, fit.FitConfig(loss="other"))


def test_steps_and_rates():
    s = fit.FitConfig(lr=0.1, warmup_epochs=2, max_epochs=6, min_lr=0.01, gradient_clip_val=1.0, weight_decay=0.5)
    assert np.allclose([s.rate(e) for e in (0, 1, 2, 4)], [0.05, 0.1, 0.1, 0.055])
    state = fit.Fit({"a": np.array([2.0, -1.0])}, {"a": np.zeros(2)}, {"a": np.zeros(2)}, epoch=2)
    fit.stepped(state, {"a": np.array([3.0, 4.0])}, s)  # clipped to 0.6, 0.8; the first step of AdamW is the rate in size
    assert np.allclose(state.params["a"], np.array([2.0, -1.0]) * (1 - 0.1 * 0.5) - 0.1, atol=1e-6) and np.allclose(state.first["a"], [0.06, 0.08])


@pytest.mark.parametrize("loss, size", [(fit.MSE, None), (fit.CRPS, None), (fit.MSE, 60)])
def test_fits_agree_whatever_the_partitions(spark, study, tmp_path, loss, size):
    _, data = study
    settings = fit.FitConfig(lr=0.05, weight_decay=0.01, warmup_epochs=1, max_epochs=3, batch_size=size, loss=loss, train_members=4)
    states = []
    for parts in (1, 3, 8) if size is None else (2,):
        dealt = build.Data(data.cell_id, data.lat, data.lon, data.target_vars, data.channels, data.norm, data.train.repartition(parts), data.val.repartition(parts), data.test)
        states.append(fit.fit(dealt, CFG, settings))
    path = f"file://{tmp_path}/checkpoints"
    for epochs in (1, 3):  # stopped after an epoch and gone on with
        again = fit.fit(data, CFG, settings, path, epochs)
    assert again.epoch == 3 and weights.checkpoints(spark, path) == ["epoch=1", "epoch=2", "epoch=3"]
    for other in states:
        assert other.losses == again.losses and other.step == again.step
        assert all((other.params[k] == again.params[k]).all() for k in again.params)
    assert again.losses[2][1] < again.losses[0][1] and all(math.isfinite(v) for _, _, v in again.losses)


def test_stored_weights(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    a, b = np.arange(6.0).reshape(2, 3), np.array(7.0)
    weights.write(spark, path, "one", {"net.model.a": a, "net.model.b": b, "other": a})
    weights.write(spark, path, "two", {"model.a": a + 1, "model.b": b})
    assert weights.checkpoints(spark, path) == ["one", "two"] and spark.read.parquet(f"{path}/tensors").count() == 3  # equal tensors once
    got = weights.load(weights.read(spark, path, "one", ("model.", "net.model.", "")))
    assert sorted(got) == ["a", "b"] and (got["a"] == a).all() and got["b"] == 7 and got["b"].shape == ()
    assert sorted(weights.load(weights.read(spark, path, "two"))) == ["model.a", "model.b"]
    with pytest.raises(FileExistsError):
        weights.write(spark, path, "one", {"a": a})
    with pytest.raises(KeyError, match="net.model.a"):
        weights.read(spark, path, "one", ("nothing.",))
    with pytest.raises(ValueError, match="bytes"):
        weights.load(weights.read(spark, path, "one"), 8)
    with pytest.raises(ValueError, match="digest"):
        weights.load(weights.read(spark, path, "two").withColumn("values", F.transform("values", lambda v: v + 1)))


def test_from_store_to_scores(spark, tmp_path):
    """Pull, build, fit, forecast and evaluate as commands, from a Zarr store to a score table."""
    store, at = f"file://{tmp_path}/raw.zarr", lambda name: str(tmp_path / name)
    zarr.write(cube_of(spark).drop("cell_id"), store, (400, 2, 2))
    (tmp_path / "cfg.json").write_text('{"surface_predictors": [], "level_predictors": [], "lead_weeks": [1, 2], "gate_leads": [1], "splits": {"train": [2005, 2007], "val": [2008, 2008], "test": [2009, 2009]}, "members": 4, "train_stride_days": 9, "fit": {"max_epochs": 2, "batch_size": null}}')
    run = lambda stage, *more: cli.main([stage, "--settings", at("cfg.json"), *more, "box.lat_min=-5", "grid=[2,2]", "step_hours=24", "fit.loss=fair_crps", "fit.lr=0.1"])
    run("pull", "--cube", store, "--out", at("cube"))
    assert spark.read.parquet(at("cube")).count() == 2 * 4 * 1826
    run("build", "--cube", store, "--out", at("data"))
    run("fit", "--data", at("data"), "--out", at("weights"))
    run("forecast", "--data", at("data"), "--weights", at("weights"), "--out", at("forecast"))
    made = spark.read.parquet(at("forecast"))
    assert made.groupBy("variable", "cell_id", "init", "lead").count().where("count <> 4").count() == 0
    run("evaluate", "--data", at("data"), "--forecast", at("forecast"), "--out", at("results"))
    scores = spark.read.csv(at("results/scores"), header=True, inferSchema=True).collect()
    assert len(scores) == 4 and all(r["crps_model"] < 2 * r["crps_clim_prob"] for r in scores)
    run("diagnose", "--cube", at("cube"), "--out", at("loss"), "--nsides", "2,4")
    assert spark.read.csv(at("loss/loss"), header=True).count() == 6
    with pytest.raises(ValueError, match="not 32 x 64"):
        cli.main(["build", "--settings", at("cfg.json"), "--cube", store, "--out", at("x")])
    with pytest.raises(ValueError):
        cli.overridden({}, ["box"])
    with pytest.raises(TypeError):
        cli.settings(spark, None, ["nothing=1"])
    assert cli.overridden({"a": {"b": 1}}, ["a.c=[1,2]", "d=text"]) == {"a": {"b": 1, "c": [1, 2]}, "d": "text"}


def test_missing_values_leave_points_out(spark, study, tmp_path):
    """NaN and infinite members and truths count as nulls do, in each metric and from a stored forecast to its scores."""
    rows = [([1.0, 2.0, 4.0], 2.5), ([math.nan, 2.0, 3.0], 1.0), ([1.0, math.inf, 3.0], 1.0), ([1.0, 2.0, 3.0], math.nan), ([0.0, 1.0, 5.0], -math.inf), ([3.0, 1.0, 2.0], 0.5)]
    frame = lambda some: spark.createDataFrame([("v", 1, 0.0, m, t) for m, t in some], "variable string, lead int, lat double, members array<double>, truth double")
    none = [([None if not math.isfinite(x) else x for x in m], t if math.isfinite(t) else None) for m, t in rows]
    whole = [rows[0], rows[5]]
    for f in (metrics.spread_error, metrics.rank_histogram, lambda p: evaluate.model_scores(p, CFG).drop("crps_clim_det")):
        a, b, c = (sorted(map(tuple, f(frame(some)).collect())) for some in (rows, none, whole))
        assert a == b == c
    one = frame(rows).select(metrics.crps(F.col("members"), F.col("truth")).alias("c"), metrics.event_probability(F.col("members"), 1.5).alias("p"), metrics.event(F.col("truth"), 0.0).alias("y")).collect()
    assert [r["c"] is None for r in one] == [False, True, True, True, True, False]
    assert [r["p"] for r in one] == [2 / 3, 2 / 3, 2 / 3, 2 / 3, 1 / 3, 2 / 3] and [r["y"] for r in one] == [1, 1, 1, 0, 0, 1]
    pairs = spark.createDataFrame([("v", 1, 0.0, 1.0, 2.0), ("v", 1, 0.0, math.nan, 1.0), ("v", 1, 0.0, 1.0, math.inf)], "variable string, lead int, lat double, f double, o double")
    assert metrics.pair_scores(pairs).first()["rmse"] == 1.0
    built, data = study
    made = fit.forecast(data.test, fit.started(CFG, fit.FitConfig(loss=fit.CRPS)).params, data, CFG)
    hole = F.xxhash64("init", "lead", "cell_id", "variable") % 5 == 0
    got = []
    for missing in (F.lit(math.nan), F.lit(None).cast("double")):
        damaged = made.withColumn("value", F.when(hole & (F.col("member") == 2), missing).otherwise(F.col("value")))
        got.append(evaluate.evaluate(damaged, built, CFG, str(tmp_path / "r")).orderBy("variable", "lead").collect())
    assert got[0] == got[1] and all(r["crps_model"] is not None and not math.isnan(r["crps_model"]) for r in got[0])


def test_folds_equal_refits(spark):
    """Leaving a fold out of sums is refitting on the other folds' rows."""
    train = cube_of(spark, 1).where("time < '2008-01-01' and not (year(time) = 2006 and dayofyear(time) = 40) and dayofyear(time) <> 70").withColumn("split", F.lit("train"))
    train = train.withColumn("value", F.when(F.dayofyear("time") == 90, F.lit(math.nan)).otherwise(F.col("value")))
    for folds in (None, 2):
        fold = crossval.by_year(F.col("time"), folds)
        rest = crossval.left_out(crossval.sums(train, fold)).persist()
        clims = crossval.climatologies(rest, 11).persist()
        norms = {(r["fold"], r["variable"]): r for r in crossval.normalizers(rest, clims).collect()}
        out = crossval.anomalies(train, fold, clims)
        assert out.count() == train.count()
        scores = {(r["fold"], r["variable"]): r for r in crossval.scores(out, crossval.normalizers(rest, clims)).collect()}
        for left in (2005, 2006) if folds is None else (0, 1):
            others = train.where((fold != left) & ~F.isnan("value"))
            clim = climatology.fit(others, 11)
            a = {(r["variable"], r["doy"]): r["clim"] for r in clim.collect()}
            b = {(r["variable"], r["doy"]): r["clim"] for r in clims.where(F.col("fold") == left).collect()}
            assert set(a) == set(b) and all(abs(a[k] - b[k]) < 1e-9 for k in a)
            for r in climatology.normalizer(climatology.anomaly(others, clim)).collect():
                n = norms[left, r["variable"]]
                assert abs(n["mean"] - r["mean"]) < 1e-9 and abs(n["std"] - r["std"]) < 1e-7
                mine = climatology.anomaly(train.where((fold == left) & ~F.isnan("value")), clim, "null").where(F.col("variable") == r["variable"]).agg(F.sqrt(F.avg(F.col("value") ** 2))).first()[0]
                if left != 2005:
                    assert abs(scores[left, r["variable"]]["rmse"] - mine) < 1e-9
        rest.unpersist(), clims.unpersist()


def batch_of(spark, rows, folder, name):
    spark.createDataFrame(rows, "variable string, time timestamp, value double").coalesce(1).write.parquet(f"{folder}/{name}.part")
    for i, p in enumerate(sorted((folder / f"{name}.part").glob("*.parquet"))):
        (folder / "in").mkdir(exist_ok=True)
        shutil.copy(p, folder / "in" / f"{name}-{i}.parquet")


def test_streamed_weeks(spark, tmp_path):
    """Rows out of order count within the delay, later ones don't; each closed week is written once."""
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)  # noqa: E731  (a Monday)
    stream = lambda: spark.readStream.schema("variable string, time timestamp, value double").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    out, log = (f"file://{tmp_path}/{k}" for k in ("out", "log"))
    read = lambda: {(str(r["week"]), r["n"], r["value"]) for r in spark.read.parquet(out).collect()}
    batch_of(spark, [("t", day(0), 1.0), ("t", day(6), 3.0), ("t", day(7), 10.0), ("t", day(8), None), ("t", day(9), math.nan)], tmp_path, "a")
    weekly.closed_weeks(stream(), out, log, "3 days", ("variable",)).awaitTermination()
    assert read() == set()
    batch_of(spark, [("t", day(3), 5.0), ("t", day(12), 20.0)], tmp_path, "b")  # in week one, which is open as of day 9 less 3
    weekly.closed_weeks(stream(), out, log, "3 days", ("variable",)).awaitTermination()
    assert read() == {("2024-01-01", 3, 3.0)}
    batch_of(spark, [("t", day(2), 99.0), ("t", day(13), 30.0), ("t", day(30), 1.0)], tmp_path, "c")  # too late, in time, far ahead
    weekly.closed_weeks(stream(), out, log, "3 days", ("variable",)).awaitTermination()
    assert read() == {("2024-01-01", 3, 3.0), ("2024-01-08", 3, 20.0)}
    now, log2 = f"file://{tmp_path}/now", f"file://{tmp_path}/log2"
    weekly.current_weeks(stream(), now, log2, "400 days", ("variable",)).awaitTermination()
    got = {(str(r["week"]), r["n"], r["value"]) for r in weekly.latest(spark.read.parquet(now), ("variable",)).collect()}
    assert got == {("2024-01-01", 4, 27.0), ("2024-01-08", 3, 20.0), ("2024-01-29", 1, 1.0)}


def test_fits_read_stored_samples(spark, monkeypatch):
    """The queries make their samples once: what a fit gets is read from files, with the same rows."""
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    seen, made, stored = [], [], build.stored
    monkeypatch.setattr(build, "stored", lambda data, *a: made.append(data) or stored(data, *a))

    def caught(data, *_):
        seen.append(data)
        raise InterruptedError

    monkeypatch.setattr(fit, "fit", caught)
    for query in (registered.fitted_predictor, registered.fitted_forecast_scores):
        with pytest.raises(InterruptedError):
            query(spark, sf)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert not [s for d in seen for s in (d.train, d.val) if "Window" in plan(s) or "InMemoryRelation" in plan(s)] and "Window" not in plan(seen[1].test)
    rows = lambda df: sorted((r["init"], r["input"], str(r["target"])) for r in df.collect())
    assert rows(seen[0].val) == rows(made[0].val)


def test_fits_take_every_nation_and_epoch(spark, monkeypatch):
    """The fitted predictors read a cell for each nation that has lines, are fitted to the last epoch, and the test block gets scores."""
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    lines, suppliers = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("lineitem", "supplier"))
    nations = {r[0] for r in lines.join(suppliers, lines["l_suppkey"] == suppliers["s_suppkey"]).select("s_nationkey").distinct().collect()}
    cells, epochs, run = [], [], fit.fit
    monkeypatch.setattr(fit, "fit", lambda data, *a: cells.append(set(data.cell_id.tolist())) or (epochs.append(run(data, *a)) or epochs[-1]))
    rows = registered.fitted_forecast_scores(spark, sf).collect()
    assert cells == [nations] and epochs[0].epoch == registered.SETTINGS.max_epochs == len(epochs[0].losses)
    assert {(r["variable"], r["lead"]) for r in rows} == {(v, k) for v in registered.CFG.targets for k in registered.CFG.lead_weeks}
    assert all(r["crps_model"] > 0 for r in rows)

    def caught(data, *_):
        cells.append(set(data.cell_id.tolist()))
        raise InterruptedError

    monkeypatch.setattr(fit, "fit", caught)
    with pytest.raises(InterruptedError):
        registered.fitted_predictor(spark, sf)
    assert cells[1] == nations
