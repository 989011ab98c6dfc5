"""Scores baselines and ensembles over the evaluation box: one row per (variable, lead)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillcube.config import Config
from skillcube.functions import columns as C
from skillcube.jobs.build import Built
from skillcube.operators import climatology, forecasts, metrics, splits, windows
from skillcube.sources import cube


def box(rows: DataFrame, cfg: Config) -> DataFrame:
    return rows.where(C.in_box(F.col("lat"), F.col("lon"), cfg.box))


def test_targets(anomalies: DataFrame, cfg: Config) -> DataFrame:
    """Weekly test targets in the box: variable, cell_id, lat, lon, init, current, lead, truth."""
    weekly = windows.weekly_mean(splits.only(anomalies, "test"))
    return box(windows.lead_targets(windows.weekly_spine(weekly), cfg.lead_weeks), cfg)


def baseline_scores(anomalies: DataFrame, cfg: Config) -> DataFrame:
    """crps, rmse of climatology (zero anomaly) and persistence, acc of persistence, where both are known.

    One pass: everything is a sum per (variable, lead, latitude), put together by latitude weights. A
    latitude of the box without a valid point keeps its weight in the spatial means.
    """
    t, p, ok = F.col("truth"), F.col("current"), F.col("truth").isNotNull() & F.col("current").isNotNull()
    sums = {"at": F.avg(F.when(ok, F.abs(t))), "ap": F.avg(F.when(ok, F.abs(p - t))), "n": F.count_if(ok)}
    sums |= {k: F.sum(F.when(ok, e)) for k, e in (("tt", t * t), ("pp", p * p), ("pt", p * t), ("ee", (p - t) * (p - t)))}
    lat = test_targets(anomalies, cfg).groupBy("variable", "lead", "lat").agg(*[e.alias(k) for k, e in sums.items()])
    lat = lat.withColumn("w", C.lat_weight(F.col("lat")))
    w, n = F.col("w"), F.nullif(F.sum("n"), F.lit(0))

    def over(k):
        return F.sum(F.col(k) * w)

    return lat.groupBy("variable", F.col("lead").alias("lead_week")).agg(
        (over("at") / F.sum(w)).alias("crps_climatology"),
        (over("ap") / F.sum(w)).alias("crps_persistence"),
        F.sqrt(over("tt") / F.avg(w) / n).alias("rmse_climatology"),
        F.sqrt(over("ee") / F.avg(w) / n).alias("rmse_persistence"),
        (over("pt") / F.nullif(F.sqrt(over("pp") * over("tt")), F.lit(0.0))).alias("acc_persistence"),
    )


def pool_points(anomalies: DataFrame, cfg: Config, truth: DataFrame | None = None) -> DataFrame:
    """Test targets with `crps` of the training pool of their week of the year."""
    train = box(windows.weekly_spine(windows.weekly_mean(splits.only(anomalies, "train"))), cfg)
    pool = forecasts.woy_pool(train.where("value is not null"), cfg.woy_window)
    return forecasts.with_pool(test_targets(anomalies, cfg) if truth is None else truth, pool, cfg.fair_crps)


def pool_scores(anomalies: DataFrame, cfg: Config) -> DataFrame:
    """crps_clim_prob: per init the latitude-weighted mean over the box, then the mean over inits."""
    rows = pool_points(anomalies, cfg).where("crps is not null")
    per_init = metrics.spatial_mean(rows, "crps", ["variable", "lead", "init"], "c")
    return per_init.groupBy("variable", "lead").agg(F.avg("c").alias("crps_clim_prob"))


def model_scores(points: DataFrame, cfg: Config) -> DataFrame:
    """What the points alone say, in one pass: sums per (variable, lead, latitude), put together by latitude weights."""
    m, t = F.col("members"), F.when(C.finite(F.col("truth")), F.col("truth"))
    rows = points.select("variable", "lead", "lat", t.alias("o"), F.size(m).alias("m"), metrics.crps(m, t, cfg.fair_crps).alias("crps"), metrics.ensemble_mean(m).alias("f"), metrics.ensemble_variance(m).alias("v"))
    f, o, ok = F.col("f"), F.col("o"), F.col("f").isNotNull() & F.col("o").isNotNull()
    sums = {"c": F.avg("crps"), "z": F.avg(F.abs(o)), "n": F.count_if(ok), "m": F.max(F.when(ok, F.col("m")))}
    sums |= {k: F.sum(F.when(ok, e)) for k, e in (("fo", f * o), ("ff", f * f), ("oo", o * o), ("ee", F.pow(f - o, 2)), ("vv", F.col("v")))}
    lat = rows.groupBy("variable", "lead", "lat").agg(*[e.alias(k) for k, e in sums.items()]).withColumn("w", C.lat_weight(F.col("lat")))
    n, top = F.nullif(F.sum("n"), F.lit(0)), F.max("m")

    def over(k):
        return F.sum(F.col(k) * F.col("w"))

    return lat.groupBy("variable", "lead").agg(
        (over("c") / F.sum("w")).alias("crps_model"),
        (over("z") / F.sum("w")).alias("crps_clim_det"),
        (over("fo") / F.nullif(F.sqrt(over("ff") * over("oo")), F.lit(0.0))).alias("acc_mean"),
        F.sqrt(over("ee") / n).alias("rmse_mean"),
        (F.sqrt((top + 1) / top * F.sum("vv") / n) / F.nullif(F.sqrt(F.sum("ee") / n), F.lit(0.0))).alias("spread_error_ratio"),
    )


def score(points: DataFrame, anomalies: DataFrame, cfg: Config) -> DataFrame:
    """The evaluation table of an ensemble: points with members and truth (anomalies, in the box)."""
    table = model_scores(points, cfg).join(pool_scores(anomalies, cfg), ["variable", "lead"], "left")
    return table.select(
        "variable", "lead", "crps_model", "crps_clim_det", "crps_clim_prob",
        metrics.skill(F.col("crps_model"), F.col("crps_clim_det")).alias("crpss_vs_det"),
        metrics.skill(F.col("crps_model"), F.col("crps_clim_prob")).alias("crpss_vs_prob"),
        "acc_mean", "rmse_mean", "spread_error_ratio",
    )


def stored_points(standard: DataFrame, built: Built, cfg: Config) -> DataFrame:
    """Points of the box out of a stored table of standardized forecasts: a row per (variable, cell_id, lat, lon, init, lead, member)."""
    rows = climatology.destandardize(cube.clean(box(standard, cfg)), built.norm)
    return forecasts.gathered(rows, test_targets(built.anomalies, cfg).select(*forecasts.POINT, "truth"))


def event_reliability(points: DataFrame, clim: DataFrame, cfg: Config) -> DataFrame:
    """A reliability curve per event of cfg, over all its leads: event, bin, center, observed, n."""
    physical = climatology.physical_points(points, clim)
    return metrics.reliability_curve(metrics.event_points(points, physical, cfg.events), cfg.reliability_bins, by=["event"])


def evaluate(standard: DataFrame, built: Built, cfg: Config, folder: str) -> DataFrame:
    """Scores a stored forecast: score table, rank histograms, reliability curves and the gate, written under folder."""
    points = stored_points(standard, built, cfg).persist()
    write_csv(score(points, built.anomalies, cfg), f"{folder}/scores")
    scores = written_scores(points, f"{folder}/scores")
    write_csv(metrics.rank_histogram(points), f"{folder}/rank_histogram", ["variable", "lead", "rank"])
    write_csv(event_reliability(points, built.climatology, cfg), f"{folder}/event_reliability", ["event", "bin"])
    passed = metrics.gate(scores, cfg.gate_leads, cfg.gate_metric, cfg.gate_threshold)
    write_csv(passed, f"{folder}/gate", ["passed"])
    points.unpersist()
    return scores


def written_scores(points: DataFrame, path: str) -> DataFrame:
    """The score table as written, so that nothing stays persisted for it."""
    kinds = "variable string, lead int, crps_model double, crps_clim_det double, crps_clim_prob double, crpss_vs_det double, crpss_vs_prob double, acc_mean double, rmse_mean double, spread_error_ratio double"
    return points.sparkSession.read.schema(kinds).csv(path, header=True)


def write_csv(table: DataFrame, path: str, order=("variable", "lead")) -> None:
    """A small table (a row per score) as one CSV file, in order."""
    by = [c for c in order if c in table.columns]
    table.coalesce(1).sortWithinPartitions(*by).write.mode("overwrite").csv(path, header=True)
