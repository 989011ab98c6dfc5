"""More registered queries: stores, mesh operators, cross-validation, streams, fitted predictors. Their SQL is in study_oracle."""

from __future__ import annotations

from math import cos, sin

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillcube.config import PRECIPITATION
from skillcube.jobs import build, evaluate, fit
from skillcube.jobs.queries import CFG, _built, _cells, _daily, _mesh, _r, _tagged
from skillcube.operators import crossval, geometry, mesh
from skillcube.session import shared_folder
from skillcube.sources import weights, zarr
from skillcube.streaming import weekly

#: Fixed weights of the attention queries, of four channels in two heads.
TO_Q = [[cos(i + 2 * j + 1) for j in range(3)] for i in range(4)]
TO_KV = [[sin(i + 3 * j + 1) / 2 for j in range(4)] for i in range(8)]
TO_O = [[cos(2 * i + j) for j in range(4)] for i in range(4)]
PIXELS, BLOCK, LEVELS, RIDGE = 192, 16, 3, 1e-3


def zarr_cube(spark, sf):
    """The daily cube after a way through a Zarr store, two variables of some chunks each."""
    path = shared_folder(spark, "zarr")
    zarr.write(_daily(spark, sf).select("variable", "lat", "lon", "time", "value"), path, (500, 10, 13))
    got = zarr.read(spark, path).where("value is not null")
    return _r(got.select("variable", "lat", "lon", F.to_date("time").alias("time"), "value"))


def zarr_years(spark, sf):
    """One variable and two years of a Zarr store: counts and means by cell."""
    path = shared_folder(spark, "zarr")
    zarr.write(_daily(spark, sf).select("variable", "lat", "lon", "time", "value"), path, (365, 25, 25))
    some = zarr.read(spark, path, [PRECIPITATION], (1996, 1997)).where("value is not null")
    return _r(some.groupBy("variable", "lat", "lon").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")))


def _channels(spark, sf):
    """id, lon, lat, x of the cells: four channels of the mean quantity and the place."""
    v = F.col("value")
    return _cells(spark, sf).select("id", "lon", "lat", F.array(v, v * v / 100, F.col("lat") / 90, F.col("lon") / 360).alias("x"))


def _spread(df: DataFrame, column: str, n: int = 4) -> list:
    return [F.element_at(column, i + 1).alias(f"x{i}") for i in range(n)]


def attention_interp(spark, sf):
    cells, to = _channels(spark, sf), _mesh(spark)
    got = mesh.attention_interpolate(geometry.knn(cells, to, 3, few=True), cells, to, mesh.Attention(TO_Q, TO_KV, TO_O, 2))
    return _r(got.select("id", *_spread(got, "x")))


def _pixels(spark, sf):
    """pix and four means of the order lines whose part falls in the pixel."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").groupBy((F.col("l_partkey") % PIXELS).cast("long").alias("pix"))
    return lines.agg((F.avg("l_quantity") / 50).alias("a"), (F.avg("l_discount") * 10).alias("b"), (F.avg("l_tax") * 10).alias("c"), (F.avg("l_extendedprice") / 50_000).alias("d"))


def block_attention(spark, sf):
    """Attention in blocks of 16 pixels, one head of four channels turned by the pixels' places."""
    rows = _pixels(spark, sf).join(geometry.healpix(spark, 4), "pix")
    rows = rows.select("pix", "lon", "lat", F.array("a", "b", "c", "d").alias("q"), F.array("b", "c", "d", "a").alias("k"), F.array("d", "a", "b", "c").alias("v"))
    got = mesh.block_attention(rows, BLOCK, 1, 4)
    return _r(got.select("pix", *_spread(got, "x")))


def _pyramid(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select((F.col("l_partkey") % (4 * PIXELS)).cast("long").alias("pix"), F.col("l_quantity").cast("double").alias("value"))
    return mesh.pyramid(lines, LEVELS)


def mesh_pyramid(spark, sf):
    return _r(_pyramid(spark, sf))


def mesh_skips(spark, sf):
    """What each pixel has beyond the one that holds it, and the mean that coming down from the coarsest level gives back."""
    means = _pyramid(spark, sf)
    skip = mesh.skips(means)
    field = skip.where(F.col("level") == LEVELS).select("pix", F.col("skip").alias("value"))
    for level in range(LEVELS - 1, -1, -1):
        field = mesh.upsample(field, skip.where(F.col("level") == level))
    return _r(skip.where("level = 0").select("pix", "skip").join(field, "pix"))


def _waves(points: DataFrame) -> DataFrame:
    """Four waves at points (id, lon, lat): one and two around a circle of latitude, two phases each."""
    lam, phi = F.radians("lon"), F.radians("lat")
    each = [F.struct(F.lit(f"{name}{n}").alias("name"), (f(n * lam) * F.cos(phi)).alias("value")) for n in (1, 2) for name, f in (("cos", F.cos), ("sin", F.sin))]
    return points.select("id", F.explode(F.array(*each)).alias("w")).select("id", "w.name", "w.value")


def fitted_interp(spark, sf):
    """Weights of the two nearest cells fitted on four waves, and the mean quantity that they give."""
    cells, to = _cells(spark, sf), _mesh(spark)
    edges = geometry.knn(cells, to, 2, few=True)
    got = mesh.fitted_weights(edges, _waves(cells), _waves(to), 2, RIDGE)
    value = mesh.apply_weights(edges, got, cells.select("id", "value"))
    return _r(got.select(F.col("to_id").alias("id"), F.element_at("weights", 1).alias("w1"), F.element_at("weights", 2).alias("w2")).join(value, "id"))


def _folds(spark, sf):
    train = _tagged(spark, sf).where("split = 'train'")
    rest = crossval.left_out(crossval.sums(train, crossval.by_year(F.col("time"))))
    return train, rest, crossval.climatologies(rest, CFG.climatology_smooth_days)


def fold_climatology(spark, sf):
    """For each training year the climatology of the others."""
    return _r(_folds(spark, sf)[2])


def fold_scores(spark, sf):
    """For each training year the normalizer of the others, and how far its days lie from their climatology."""
    train, rest, clims = _folds(spark, sf)
    norms = crossval.normalizers(rest, clims)
    got = crossval.scores(crossval.anomalies(train, crossval.by_year(F.col("time")), clims), norms)
    return _r(got.join(norms, ["fold", "variable"]).select("fold", "variable", "n", "rmse", "mean", "std"))


def streamed_weekly_mean(spark, sf):
    """Weekly means by event type of events that stream in, out of order, in eight files."""
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("variable"), F.col("ts").cast("timestamp").alias("time"), "value")
    source, out, log = (shared_folder(spark, f"stream-{k}") for k in ("in", "out", "log"))
    events.repartition(8, F.xxhash64("time", "value")).write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(source)
    weekly.current_weeks(stream, out, log, "4000 days", ("variable",)).awaitTermination()
    return _r(weekly.latest(spark.read.parquet(out), ("variable",)))


SETTINGS = fit.FitConfig(lr=0.05, weight_decay=0.01, warmup_epochs=1, max_epochs=4, batch_size=None)


def _data(spark, sf, cells=25):
    built = _built(spark, sf, cells)
    return built, build.data(built, CFG)


def fit_gradients(spark, sf):
    """Loss and gradients of a linear predictor of zero over the training samples."""
    _, data = _data(spark, sf, 5)
    loss, n, g = fit.gradients(data.train, fit.started(CFG, SETTINGS).params, data.cell_weights(), SETTINGS, 0)
    rows = [(o, i, float(v), loss, n) for o, row in enumerate(g["weight"]) for i, v in enumerate(row)] + [(o, None, float(v), loss, n) for o, v in enumerate(g["bias"])]
    return _r(spark.createDataFrame(rows, "output int, input int, gradient double, loss double, n long"), 5)


def fitted_predictor(spark, sf):
    """Losses by epoch of a predictor fitted with checkpoints, each epoch by a fit that goes on from the last."""
    _, data = _data(spark, sf)
    data = build.stored(data, shared_folder(spark, "samples"), ("train", "val"))
    path = shared_folder(spark, "checkpoints")
    for epochs in range(1, SETTINGS.max_epochs + 1):
        state = fit.fit(data, CFG, SETTINGS, path, epochs)
    return _r(spark.createDataFrame(state.losses, "epoch int, train_loss double, val_loss double"), 4)


def fitted_forecast_scores(spark, sf):
    """A predictor fitted to the end and read back from its last checkpoint, its forecasts of the test block scored."""
    built, data = _data(spark, sf)
    data = build.stored(data, shared_folder(spark, "samples"))
    path = shared_folder(spark, "checkpoints")
    last = fit.fit(data, CFG, SETTINGS, path).epoch
    params = weights.load(weights.read(spark, path, f"epoch={last}", ("net.model.", "model.")))
    points = evaluate.stored_points(fit.forecast(data.test, params, data, CFG), built, CFG)
    return _r(evaluate.score(points, built.anomalies, CFG), 4)


QUERIES = {f.__name__: f for f in (
    zarr_cube, zarr_years, attention_interp, block_attention, mesh_pyramid, mesh_skips, fitted_interp,
    fold_climatology, fold_scores, streamed_weekly_mean, fit_gradients, fitted_predictor, fitted_forecast_scores,
)}
