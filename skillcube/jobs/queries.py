"""The registered queries: each operator on cubes that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillcube.config import PRECIPITATION, Box, Config, Event, Splits
from skillcube.functions import columns as C
from skillcube.jobs import build, evaluate
from skillcube.operators import climatology, forecasts, geometry, metrics, splits, windows
from skillcube.session import shared_folder
from skillcube.sources import cube

LEADS = (1, 2, 3, 4, 5, 6)
#: The tables' years; the box holds cells 5 to 14, any longitude.
EVENTS = (
    Event("quantity_above_season", "quantity", "anomaly", "gt", 0.0),
    Event("rain_below_season", PRECIPITATION, "anomaly", "lt", -0.005),
    Event("high_quantity", "quantity", "physical", "gt", 26.0),
    Event("little_rain", PRECIPITATION, "physical", "lt", 0.049),
)
CFG = Config(events=EVENTS, targets=("quantity", PRECIPITATION), surface_predictors=(), level_predictors=(), splits=Splits((1995, 1998), (1999, 1999), (2000, 2001)), box=Box(-35.0, 10.0, 0.0, 360.0), lead_weeks=LEADS)
MEMBERS = 5


def _r(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation doesn't show; negative zero as zero."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _daily(spark, sf, cells=25):
    return cube.from_orders(spark, sf, cells)


def _tagged(spark, sf, cells=25):
    return splits.tagged(_daily(spark, sf, cells), CFG.splits)


def _built(spark, sf, cells=25):
    return build.build(_daily(spark, sf, cells), CFG, missing="null")


def _weekly(spark, sf):
    return windows.weekly_mean(_built(spark, sf).anomalies)


def _spine(spark, sf):
    return windows.weekly_spine(_weekly(spark, sf))


def _lagged(spark, sf):
    """Test points in the box with the last weeks' anomalies as members."""
    spine = windows.weekly_spine(windows.weekly_mean(splits.only(_built(spark, sf).anomalies, "test")))
    return evaluate.box(forecasts.lagged(spine, MEMBERS, LEADS), CFG)


def daily_mean(spark, sf):
    return _r(_daily(spark, sf).drop("lat", "lon"))


def six_hour_resample(spark, sf):
    return _r(cube.daily_mean(cube.from_events(spark, sf)).select("variable", "time", "value"))


def time_gap_check(spark, sf):
    return cube.time_steps(cube.from_events(spark, sf))


def cube_summary(spark, sf):
    return _r(cube.summary(_daily(spark, sf)))


def weekly_mean(spark, sf):
    return _r(windows.weekly_mean(_daily(spark, sf)).drop("lat", "lon"))


def weekly_spine(spark, sf):
    return _r(windows.weekly_spine(windows.weekly_mean(_tagged(spark, sf))).drop("lat", "lon"))


def split_census(spark, sf):
    return splits.census(splits.tagged(_daily(spark, sf), CFG.splits, keep_embargo=True))


def box_filter(spark, sf):
    return _r(evaluate.box(_daily(spark, sf), CFG).groupBy("variable", "cell_id", "lat", "lon").agg(F.count("value").alias("n"), F.avg("value").alias("mean")))


def season_month_mean(spark, sf):
    return _r(splits.months_mean(evaluate.box(_tagged(spark, sf), CFG)))


def doy_climatology(spark, sf):
    return _r(climatology.doy_means(_tagged(spark, sf)))


def smoothed_climatology(spark, sf):
    return _r(climatology.fit(_tagged(spark, sf), CFG.climatology_smooth_days))


def anomaly(spark, sf):
    return _r(_built(spark, sf).anomalies.drop("lat", "lon"))


def normalizer(spark, sf):
    return _r(_built(spark, sf).norm)


def standardized(spark, sf):
    b = _built(spark, sf)
    return _r(climatology.standardize(b.anomalies, b.norm).drop("lat", "lon"))


def physical_reconstruction(spark, sf):
    b = _built(spark, sf)
    z = climatology.standardize(b.anomalies, b.norm)
    return _r(climatology.physical(climatology.destandardize(z, b.norm), b.climatology).drop("lat", "lon", "value"))


def rolling7(spark, sf):
    return _r(windows.rolling7(windows.daily_spine(_tagged(spark, sf, 5))).drop("lat", "lon"))


def lead_targets(spark, sf):
    return _r(windows.lead_targets(_spine(spark, sf), LEADS).drop("lat", "lon"))


def valid_init_weeks(spark, sf):
    return windows.valid_inits(_spine(spark, sf), max(LEADS)).groupBy("split", "variable", "cell_id").agg(F.count(F.lit(1)).alias("n"), F.min("week").alias("first"), F.max("week").alias("last"))


def history_windows(spark, sf):
    w = windows.weekly_windows(_spine(spark, sf), 2, LEADS)
    return _r(w.select("split", "variable", "cell_id", "init", *[F.col("history")[k].alias(f"h{k}") for k in range(2)], *[F.col("targets")[k - 1].alias(f"t{k}") for k in LEADS]))


def daily_init_windows(spark, sf):
    rows = windows.daily_windows(windows.daily_spine(_tagged(spark, sf, 5).where("split <> 'test'")), 2, LEADS, CFG.train_stride_days)
    return _r(rows.select("split", "variable", "cell_id", "init", *[F.col("history")[k].alias(f"h{k}") for k in range(2)], *[F.col("targets")[k - 1].alias(f"t{k}") for k in LEADS]))


def season_channel(spark, sf):
    days = _tagged(spark, sf).select("time").distinct()
    return _r(days.select("time", C.season(F.col("time")).cast("double").alias("season")), 5)


def packed_samples(spark, sf):
    b = _built(spark, sf, 5)
    s = build.samples(b.anomalies, b.norm, CFG, "train")
    total = lambda c: F.aggregate(F.transform(c, lambda x: F.coalesce(x, F.lit(0.0)).cast("double")), F.lit(0.0), lambda a, x: a + x)
    return _r(s.select("init", F.size("input").alias("n_input"), F.size("target").alias("n_target"), total("input").alias("input_sum"), total("target").alias("target_sum")), 3)


def climatology_forecast(spark, sf):
    inits = splits.only(_weekly(spark, sf), "test").withColumnRenamed("week", "init")
    f = forecasts.climatology(inits, LEADS)
    return f.groupBy("variable", "lead").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def persistence_forecast(spark, sf):
    inits = splits.only(_weekly(spark, sf), "test").withColumnRenamed("week", "init")
    return _r(forecasts.persistence(inits, LEADS).drop("lat", "lon"))


def baseline_scores(spark, sf):
    return _r(evaluate.baseline_scores(_built(spark, sf).anomalies, CFG))


def woy_pool(spark, sf):
    train = splits.only(_weekly(spark, sf), "train")
    pool = forecasts.woy_pool(train, CFG.woy_window)
    return _r(pool.select("variable", "cell_id", "target_woy", F.size("members").alias("n"), F.element_at("members", 1).alias("least"), F.element_at("members", -1).alias("largest")))


def _crps(spark, sf, fair):
    rows = _lagged(spark, sf).withColumn("crps", metrics.crps(F.col("members"), F.col("truth"), fair))
    return _r(rows.where("crps is not null").select("variable", "cell_id", "init", "lead", "crps"))


def crps_biased(spark, sf):
    return _crps(spark, sf, False)


def crps_fair(spark, sf):
    return _crps(spark, sf, True)


def crps_woy_climatology(spark, sf):
    return _r(evaluate.pool_scores(_built(spark, sf).anomalies, CFG))


def fair_crps_loss(spark, sf):
    return _r(metrics.fair_crps_loss(_lagged(spark, sf)))


def weighted_mse(spark, sf):
    return _r(metrics.weighted_mse(_lagged(spark, sf).select("variable", "lead", "lat", metrics.ensemble_mean(F.col("members")).alias("f"), F.col("truth").alias("o"))))


def evaluation_scores(spark, sf):
    return _r(evaluate.score(_lagged(spark, sf), _built(spark, sf).anomalies, CFG))


def crpss(spark, sf):
    s = evaluate.baseline_scores(_built(spark, sf).anomalies, CFG)
    return _r(s.select("variable", "lead_week", metrics.skill(F.col("crps_persistence"), F.col("crps_climatology")).alias("crpss")))


def rank_histogram(spark, sf):
    return _r(metrics.rank_histogram(_lagged(spark, sf)))


def spread_error_ratio(spark, sf):
    return _r(metrics.spread_error(_lagged(spark, sf)))


def event_probability(spark, sf):
    rows = _lagged(spark, sf).where("truth is not null")
    return _r(rows.select("variable", "cell_id", "init", "lead", metrics.event_probability(F.col("members"), 0.0).alias("p_gt"), metrics.event_probability(F.col("members"), 0.0, "lt").alias("p_lt")))


def reliability_curve(spark, sf):
    rows = _lagged(spark, sf).where("truth is not null")
    return _r(metrics.reliability_curve(rows.select("variable", "lead", metrics.event_probability(F.col("members"), 0.0).alias("p"), metrics.event(F.col("truth"), 0.0).alias("y")), CFG.reliability_bins))


def reliability_ranks(spark, sf):
    rows = _lagged(spark, sf).where(metrics.complete(F.col("members")) & F.col("truth").isNotNull())
    return _r(metrics.reliability_ranks(rows))


def decision_gate(spark, sf):
    scores = evaluate.score(_lagged(spark, sf), _built(spark, sf).anomalies, CFG)
    return metrics.gate(scores, CFG.gate_leads, CFG.gate_metric, CFG.gate_threshold)


def _cells(spark, sf):
    """Cells with their mean quantity: id, lon, lat, value."""
    d = _daily(spark, sf).where("variable = 'quantity'")
    return d.groupBy(F.col("cell_id").alias("id"), "lon", "lat").agg(F.avg("value").alias("value"))


def _mesh(spark, step=30.0):
    g = geometry.lonlat_grid(spark, step)
    return g.select(F.col("cell_id").alias("id"), "lon", "lat")


def haversine_knn(spark, sf):
    return _r(geometry.knn(_cells(spark, sf), _mesh(spark), 3, few=True).select("to_id", "rank", "dist"))


def idw_interp(spark, sf):
    cells = _cells(spark, sf)
    return _r(geometry.interpolate(geometry.knn(cells, _mesh(spark), 3, few=True), cells.select("id", "value")))


def idw_roundtrip_rmse(spark, sf):
    cells = _cells(spark, sf)
    mesh = geometry.healpix(spark, 4).withColumnRenamed("pix", "id")
    back = geometry.round_trip(cells, mesh, cells.select("id", "value")).withColumnRenamed("value", "f")
    return _r(geometry.weighted_rmse(back.join(cells.select("id", "lat", F.col("value").alias("o")), "id")))


def _fields(spark, sf):
    """Weekly test fields on a grid of 5 by 5 cells."""
    w = splits.only(_weekly(spark, sf), "test")
    return w.select(F.col("week").alias("sample"), F.col("variable").alias("channel"), F.floor(F.col("cell_id") / 5).cast("int").alias("lat_idx"), (F.col("cell_id") % 5).alias("lon_idx"), "value")


def tile_noise_members(spark, sf):
    """Perturbed weekly fields, with the identity as predictor."""
    return _r(forecasts.ensemble(_fields(spark, sf), [lambda x: x], (0, 1, 2, 3), 0.1).groupBy("member", "channel").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")))


def _scaled(batches, members):
    """A stand-in for a model with noise of its own: member m is the field times 1 + m / 10."""
    import pandas as pd

    for pdf in batches:
        yield pd.concat([pdf.assign(member=m, value=pdf["value"] * (1 + m / 10)) for m in range(members)])


def drawn_members(spark, sf):
    """Members that a model draws itself, chosen as the source."""
    fields = _fields(spark, sf).where("value is not null")
    out = forecasts.members_of(fields, CFG.with_(members=3), fields.withColumn("member", F.lit(0)).schema, noisy=_scaled)
    return _r(out.groupBy("member", "channel").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")), 5)


def _stored(spark, sf, built):
    """The lagged ensemble as a table of standardized forecasts, a row per member."""
    spine = windows.weekly_spine(windows.weekly_mean(splits.only(built.anomalies, "test")))
    points = forecasts.lagged(spine, MEMBERS, LEADS).drop("split", "truth")
    rows = points.select("variable", "cell_id", "lat", "lon", "init", "lead", F.posexplode("members").alias("member", "value"))
    return climatology.standardize(rows, built.norm)


def forecast_join(spark, sf):
    b = _built(spark, sf)
    points = evaluate.stored_points(_stored(spark, sf, b), b, CFG)
    return _r(points.select("variable", "cell_id", "init", "lead", F.size("members").alias("n"), metrics.ensemble_mean(F.col("members")).alias("mean"), "truth"))


def forecast_scores(spark, sf):
    b = _built(spark, sf)
    return _r(evaluate.score(evaluate.stored_points(_stored(spark, sf, b), b, CFG), b.anomalies, CFG))


def event_reliability(spark, sf):
    return _r(evaluate.event_reliability(_lagged(spark, sf), _built(spark, sf).climatology, CFG))


def level_flattening(spark, sf):
    """Order lines with their line number as level."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_linenumber").cast("int").alias("level"), F.col("l_shipdate").alias("time"), "l_quantity", "l_extendedprice")
    long = lines.unpivot(["level", "time"], ["l_quantity", "l_extendedprice"], "variable", "value")
    flat = cube.flatten_levels(long, [("l_quantity", (1, 2)), ("l_extendedprice", (3,))])
    return _r(flat.groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")), 4)


def year_range(spark, sf):
    d = cube.years(_daily(spark, sf), (1996, 1997))
    return _r(d.groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("first"), F.max("time").alias("last"), F.avg("value").alias("mean")))


def stored_cube(spark, sf):
    """Written by split and read again, one split at a time."""
    path = shared_folder(spark, "cube")
    cube.write_cube(_tagged(spark, sf), path)
    parts = [cube.read_cube(spark, path, CFG, split=s) for s in ("train", "test")]
    return _r(parts[0].unionByName(parts[1]).groupBy("split", "variable").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cell_id").alias("cells"), F.avg("value").alias("mean")))


def sample_batches(spark, sf):
    """Validation samples in a seeded order, cut into batches of 16."""
    b = _built(spark, sf, 5)
    s = build.batches(build.shuffled(build.samples(b.anomalies, b.norm, CFG, "val"), seed=7), 16)
    return s.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"), F.max("place").alias("last"))


def healpix_pixels(spark, sf):
    """The pixel centre nearest to each cell, and the pixel that holds it on a mesh four times coarser."""
    mesh = geometry.healpix(spark, 4)
    near = geometry.knn(mesh.withColumnRenamed("pix", "id"), _cells(spark, sf), 1, few=True)
    return _r(near.join(mesh, F.col("from_id") == F.col("pix")).select(F.col("to_id").alias("id"), "pix", geometry.coarser(F.col("pix"), 4).alias("parent"), "lon", "lat", "dist"))


def wave_fields(spark, sf):
    return _r(geometry.waves(_cells(spark, sf)).where("name <> 'noise'"))


def loss_by_resolution(spark, sf):
    """Round-trip loss of the waves at the cells of the box."""
    got = geometry.loss_by_resolution(geometry.points_of(spark, _daily(spark, sf)), spark, (2, 4), 4, CFG.box)
    return _r(got.where("name <> 'noise'"))


def spherical_twins(spark, sf):
    """Unit vectors of the cells."""
    v = C.unit_vector(F.col("lat"), F.col("lon"))
    return _r(_cells(spark, sf).select("id", v["x"].alias("x"), v["y"].alias("y"), v["z"].alias("z")))


QUERIES = {f.__name__: f for f in (
    daily_mean, six_hour_resample, time_gap_check, cube_summary, weekly_mean, weekly_spine, split_census, box_filter, season_month_mean,
    doy_climatology, smoothed_climatology, anomaly, normalizer, standardized, physical_reconstruction,
    rolling7, lead_targets, valid_init_weeks, history_windows, daily_init_windows, season_channel, packed_samples,
    climatology_forecast, persistence_forecast, baseline_scores, woy_pool, crps_biased, crps_fair, crps_woy_climatology, crpss, fair_crps_loss, weighted_mse,
    rank_histogram, spread_error_ratio, event_probability, reliability_curve, reliability_ranks, evaluation_scores, decision_gate,
    haversine_knn, idw_interp, idw_roundtrip_rmse, tile_noise_members, drawn_members,
    forecast_join, forecast_scores, event_reliability, level_flattening, year_range, stored_cube, sample_batches,
    healpix_pixels, wave_fields, loss_by_resolution, spherical_twins,
)}
