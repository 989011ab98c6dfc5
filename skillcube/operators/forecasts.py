"""Reference forecasts and ensembles: rows (source, member, init, lead, variable, cell_id, value), or
points with an array of members."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillcube.config import Config
from skillcube.functions import columns as C
from skillcube.operators import metrics

POINT = ["variable", "cell_id", "lat", "lon", "init", "lead"]


def _leads(leads) -> Column:
    return F.explode(F.array(*map(F.lit, leads))).alias("lead")


def climatology(inits: DataFrame, leads) -> DataFrame:
    """The seasonal cycle itself: anomaly zero at every lead."""
    return inits.select("variable", "cell_id", "lat", "lon", "init", _leads(leads), F.lit(0.0).alias("value"))


def persistence(inits: DataFrame, leads) -> DataFrame:
    """The anomaly of the init week (`value`) at every lead."""
    return inits.select("variable", "cell_id", "lat", "lon", "init", _leads(leads), "value")


def near_weeks(spark, window: int) -> DataFrame:
    """(target_woy, woy): weeks 1 to 53 within `window` of each other on the 52-week ring; 53 * 53 rows at most."""
    weeks = spark.range(1, 54).select(F.col("id").cast("int").alias("target_woy"), F.explode(F.sequence(F.lit(1), F.lit(53))).alias("woy"))
    return weeks.where(C.week_distance(F.col("target_woy"), F.col("woy")) <= window)


def woy_pool(train_weekly: DataFrame, window: int) -> DataFrame:
    """variable, cell_id, target_woy, members (sorted), apart: training weeks near each week of the year.

    A row of the series goes to the few weeks it is near, by an equality join on its own week; a pool
    holds at most 2 * window + 1 weeks of each year. apart: the members' part of the CRPS, which no truth changes.
    """
    near = F.broadcast(near_weeks(train_weekly.sparkSession, window))
    rows = train_weekly.withColumn("woy", F.weekofyear("week").cast("int")).join(near, "woy")
    pool = rows.groupBy("variable", "cell_id", "target_woy").agg(F.array_sort(F.collect_list("value")).alias("members"), F.count_if(F.col("value").isNull()).alias("n_missing"))
    return pool.withColumn("apart", metrics.apart(F.col("members")))


def with_pool(truth: DataFrame, pool: DataFrame, fair: bool = True) -> DataFrame:
    """Points (init, lead, truth) with crps: that of the pool of their target's week, in the same columns.

    The points of a pool are gathered first (an init of that week and a lead each), so a pool's members meet them in one row.
    """
    at = F.weekofyear(F.date_add("init", F.col("lead") * 7)).cast("int")
    keys, rest = ["variable", "cell_id", "target_woy"], [c for c in truth.columns if c not in ("variable", "cell_id")]
    groups = truth.withColumn("target_woy", at).groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias("points"))
    score = F.transform("points", lambda p: p.withField("crps", metrics.crps_from(F.col("members"), F.col("apart"), p.truth, fair)))
    rows = groups.join(pool.drop("n_missing"), keys).select("variable", "cell_id", F.explode(score).alias("p"))
    return rows.select("variable", "cell_id", *[f"p.{c}" for c in (*rest, "crps")])


def lagged(spine: DataFrame, members: int, leads) -> DataFrame:
    """An ensemble of the last `members` weeks' anomalies, held at every lead: points with members and truth."""
    keys = [c for c in ("split", "variable", "cell_id", "lat", "lon") if c in spine.columns]
    w = Window.partitionBy(*keys).orderBy("week")
    ahead = F.array(*[F.struct(F.lit(k).alias("lead"), F.lead("value", k).over(w).alias("truth")) for k in leads])
    rows = spine.withColumn("members", F.array(*[F.lag("value", k).over(w) for k in range(members)])).withColumn("ahead", ahead).withColumn("t", F.explode("ahead"))
    return rows.select(*keys, F.col("week").alias("init"), "t.lead", "t.truth", "members")


def gathered(forecasts: DataFrame, truth: DataFrame) -> DataFrame:
    """Points out of long forecasts (a row per member) and truth rows with the same point columns."""
    by = [c for c in POINT if c in forecasts.columns]
    m = forecasts.groupBy(*by).agg(F.collect_list(F.struct(F.col("value").isNull().alias("no"), "value")).alias("_m"))
    return m.join(truth, by).withColumn("members", F.transform("_m", lambda x: x.value)).drop("_m")


def tile_noise(fields: DataFrame, seeds, std: float) -> DataFrame:
    """A perturbed copy of the fields per seed: normal noise on one tile of half the grid's extent per side.

    fields: sample, channel, lat_idx, lon_idx, value. The tile is the same for all samples and channels
    of a seed; noise is fixed by (seed, sample, channel, place), so it doesn't depend on partitioning.
    """
    size = F.broadcast(fields.agg((F.max("lat_idx") + 1).alias("h"), (F.max("lon_idx") + 1).alias("w")))  # one row
    seed = F.col("seed")
    th, tw = F.greatest(F.lit(1), F.floor(F.col("h") / 2)), F.greatest(F.lit(1), F.floor(F.col("w") / 2))
    rows = fields.join(size).withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    top, left = F.pmod(F.xxhash64(seed, F.lit("top")), F.col("h") - th + 1), F.pmod(F.xxhash64(seed, F.lit("left")), F.col("w") - tw + 1)
    inside = F.col("lat_idx").between(top, top + th - 1) & F.col("lon_idx").between(left, left + tw - 1)
    noise = F.when(inside, C.gaussian(seed, F.col("sample"), F.col("channel"), F.col("lat_idx"), F.col("lon_idx")) * std).otherwise(0.0)
    member = F.array_position(F.array(*[F.lit(int(s)) for s in seeds]), seed) - 1
    return rows.withColumn("value", F.col("value") + noise).withColumn("member", member.cast("int")).drop("h", "w", "seed")


#: name -> function of (samples, member) giving rows (sample, lead, variable, cell_id, value)
Predictor = Callable[[DataFrame], DataFrame]


def ensemble(fields: DataFrame, predictors: list[Predictor], seeds, std: float) -> DataFrame:
    """One member per seed, predictors taken in turn, each seeing its own perturbed fields."""
    if not predictors:
        raise ValueError("an ensemble needs a predictor")
    noisy, out = tile_noise(fields, seeds, std), None
    for i, predict in enumerate(predictors):
        part = predict(noisy.where(F.col("member") % len(predictors) == i))
        out = part if out is None else out.unionByName(part)
    return out


def batched(predict: Callable, schema: str) -> Predictor:
    """A model as a predictor: `predict` maps an iterator of pandas batches of samples, in Arrow transfer."""
    return lambda samples: samples.mapInPandas(predict, schema)


def drawn(samples: DataFrame, predict: Callable, schema: str, members: int) -> DataFrame:
    """Members from a model's own noise: `predict` maps (pandas batches of samples, members) to rows with a column member.

    Samples stream through in Arrow batches, so a task holds one batch with its members.
    """
    if members < 1:
        raise ValueError("an ensemble needs a member")
    return samples.mapInPandas(lambda batches: predict(batches, members), schema)


def members_of(samples: DataFrame, cfg: Config, schema: str, noisy: Callable | None = None, predictors: list[Predictor] = ()) -> DataFrame:
    """An ensemble from the source that cfg.member_source names: 'internal' (`noisy` draws cfg.members itself) or 'perturbed' fields
    (a predictor per member, in turn); 'auto' takes the first that is there."""
    source = cfg.member_source
    if source == "auto":
        source = "internal" if noisy is not None else "perturbed"
    if source == "internal":
        if noisy is None:
            raise ValueError("no model draws members itself")
        return drawn(samples, noisy, schema, cfg.members)
    if source != "perturbed":
        raise ValueError(f"unknown member source: {source!r}")
    return ensemble(samples, list(predictors), range(cfg.members), cfg.noise_std)
