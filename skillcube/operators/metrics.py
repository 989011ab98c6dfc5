"""Verification of forecasts. Points are rows (variable, lead, lat, lon, init, members, truth); scores are
one row per (variable, lead), never pooled over variables.

Missing values are null. A point with a missing member or truth has no CRPS and leaves rank histograms
and spread out; in an event probability a missing member counts as a miss.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillcube.functions import columns as C

SCORE = ["variable", "lead"]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def complete(members: Column) -> Column:
    """No member is missing: null, NaN or infinite."""
    return ~F.exists(members, lambda x: ~C.finite(x))


def apart(members: Column) -> Column:
    """Half the sum of all pairs' distances: over sorted members x_0 .. x_(m-1) the sum of (2 k - (m - 1)) x_k, so no pair is formed."""
    m = F.size(members)
    return _sum(F.transform(F.array_sort(members), lambda x, k: (2 * k - (m - 1)) * x))


def crps_from(members: Column, apart_: Column, truth: Column, fair: bool) -> Column:
    """crps with the members' part given."""
    m = F.size(members)
    near = _sum(F.transform(members, lambda x: F.abs(x - truth))) / m
    pairs = m * (m - 1) if fair else m * m
    return F.when(complete(members) & C.finite(truth) & (m > 0), F.when(m == 1, near).otherwise(near - apart_ / F.nullif(pairs, F.lit(0))))


def crps(members: Column, truth: Column, fair: bool = False) -> Column:
    """Mean distance to the truth less half the mean distance between members.

    fair: over m (m - 1) pairs in place of m * m. One member: the distance alone.
    """
    return crps_from(members, apart(members), truth, fair)


def skill(model: Column, reference: Column) -> Column:
    """1 - model / reference; null where the reference is zero or not finite."""
    ok = reference.isNotNull() & (reference != 0) & ~F.isnan(reference) & (F.abs(reference) != float("inf"))
    return F.when(ok, 1 - model / reference)


def spatial_mean(rows: DataFrame, value: str, by=SCORE, out: str = "mean") -> DataFrame:
    """Mean over time and longitude of each latitude, then over latitudes by cosine.

    A latitude without any value adds nothing above but keeps its weight below.
    """
    lat = rows.groupBy(*by, "lat").agg(F.avg(value).alias("m")).withColumn("w", C.lat_weight(F.col("lat")))
    return lat.groupBy(*by).agg((F.sum(F.col("m") * F.col("w")) / F.sum("w")).alias(out))


def pair_scores(pairs: DataFrame, weight: str | None = "normalized", by=SCORE) -> DataFrame:
    """acc (uncentred correlation) and rmse of columns f and o over rows where both are present.

    weight: 'normalized' cosine over its mean of the latitudes, 'plain' cosine, or None. The two weighted
    RMSEs differ by the square root of the mean cosine.
    """
    w = F.lit(1.0) if weight is None else C.lat_weight(F.col("lat"))
    both = C.finite(F.col("f")) & C.finite(F.col("o"))
    keys = [*by] if weight is None else [*by, "lat"]
    s = pairs.groupBy(*keys).agg(
        F.count_if(both).alias("n"),
        *[F.sum(F.when(both, e)).alias(k) for k, e in (("fo", F.col("f") * F.col("o")), ("ff", F.col("f") * F.col("f")), ("oo", F.col("o") * F.col("o")), ("ee", F.pow(F.col("f") - F.col("o"), 2)))],
    ).withColumn("w", w)
    n, mean_w = F.nullif(F.sum("n"), F.lit(0)), F.avg("w") if weight == "normalized" else F.lit(1.0)
    norm = F.sqrt(F.sum(F.col("ff") * F.col("w")) * F.sum(F.col("oo") * F.col("w")))
    return s.groupBy(*by).agg((F.sum(F.col("fo") * F.col("w")) / F.nullif(norm, F.lit(0.0))).alias("acc"), F.sqrt(F.sum(F.col("ee") * F.col("w")) / mean_w / n).alias("rmse"))


def ensemble_mean(members: Column) -> Column:
    return F.when(complete(members), _sum(members) / F.size(members))


def ensemble_variance(members: Column) -> Column:
    """Sample variance; zero for one member."""
    mean, m = ensemble_mean(members), F.size(members)
    return F.when(m == 1, F.lit(0.0)).otherwise(_sum(F.transform(members, lambda x: F.pow(x - mean, 2))) / (m - 1))


def spread_error(points: DataFrame, by=SCORE) -> DataFrame:
    """sqrt((m + 1) / m * mean variance) over the RMSE of the ensemble mean; null without points or error."""
    rows = points.select(*by, F.size("members").alias("m"), ensemble_mean(F.col("members")).alias("mean"), ensemble_variance(F.col("members")).alias("var"), "truth")
    rows = rows.where(C.finite(F.col("mean")) & C.finite(F.col("truth")) & C.finite(F.col("var")))
    s = rows.groupBy(*by).agg(F.max("m").alias("m"), F.avg("var").alias("var"), F.sqrt(F.avg(F.pow(F.col("mean") - F.col("truth"), 2))).alias("rmse"))
    return s.select(*by, (F.sqrt((F.col("m") + 1) / F.col("m") * F.col("var")) / F.nullif("rmse", F.lit(0.0))).alias("spread_error_ratio"))


def rank_histogram(points: DataFrame, by=SCORE) -> DataFrame:
    """rank (0 to m), count: ranks of the truth among the members.

    A truth that ties with t members counts 1 / (t + 1) in each of the ranks it may take: the expected
    counts of random tie-breaking, without its draw.
    """
    rows = points.where(complete(F.col("members")) & C.finite(F.col("truth")))
    below = F.size(F.filter("members", lambda x: x < F.col("truth")))
    ties = F.size(F.filter("members", lambda x: x == F.col("truth")))
    spread = rows.select(*by, F.size("members").alias("m"), ties.alias("ties"), F.explode(F.sequence(below, below + ties)).alias("rank"))
    counts = spread.groupBy(*by, "rank").agg(F.sum(1 / (F.col("ties") + 1)).alias("c"), F.max("m").alias("m"))
    whole = counts.groupBy(*by).agg(F.max("m").alias("m"), F.map_from_entries(F.collect_list(F.struct("rank", "c"))).alias("got"))  # m + 1 ranks
    filled = F.transform(F.sequence(F.lit(0), "m"), lambda k: F.struct(k.alias("rank"), F.coalesce(F.try_element_at("got", k), F.lit(0.0)).alias("count")))
    return whole.select(*by, F.explode(filled).alias("r")).select(*by, "r.rank", "r.count")


def event_probability(members: Column, threshold: float, comparison: str = "gt") -> Column:
    """Share of members beyond the threshold; missing ones are not."""
    if comparison not in ("gt", "lt"):
        raise ValueError(f"unknown comparison: {comparison!r}")
    hit = (lambda x: C.nan_to_null(x) > threshold) if comparison == "gt" else (lambda x: x < threshold)
    return F.size(F.filter(members, lambda x: F.coalesce(hit(x), F.lit(False)))) / F.size(members)


def event(truth: Column, threshold: float, comparison: str = "gt") -> Column:
    return F.coalesce((C.nan_to_null(truth) > threshold) if comparison == "gt" else (truth < threshold), F.lit(False)).cast("double")


def bin_edges(bins: int) -> list[float]:
    """Inner edges of equal bins from 0 to 1, as linspace gives them."""
    return np.linspace(0.0, 1.0, bins + 1)[1:-1].tolist()


def reliability_curve(rows: DataFrame, bins: int = 10, by=SCORE) -> DataFrame:
    """bin, center, observed, n from columns p (probability) and y (0 or 1); observed is null in empty bins."""
    at = sum(((F.col("p") >= e).cast("int") for e in bin_edges(bins)), F.lit(0))
    got = rows.where(C.finite(F.col("p")) & C.finite(F.col("y"))).withColumn("bin", at)
    counts = got.groupBy(*by, "bin").agg(F.avg("y").alias("observed"), F.count(F.lit(1)).alias("c"))
    every = counts.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    edges = np.linspace(0.0, 1.0, bins + 1)
    centers = F.array(*[F.lit(float(c)) for c in 0.5 * (edges[:-1] + edges[1:])])
    return every.join(counts, [*by, "bin"], "left").select(*by, "bin", F.element_at(centers, F.col("bin") + 1).alias("center"), "observed", F.coalesce("c", F.lit(0)).alias("n"))


def reliability_ranks(points: DataFrame, bins: int = 10, by=SCORE) -> DataFrame:
    """nominal, observed: how often the truth lies at or below the members' quantile of each nominal probability."""
    m = F.size("members")
    nominal = [(i + 0.5) / bins for i in range(bins)]
    each = F.array(*[F.struct(F.lit(p).alias("nominal"), F.element_at(F.array_sort("members"), F.least(F.floor(F.lit(p) * m), m - 1).cast("int") + 1).alias("bar")) for p in nominal])
    rows = points.withColumn("q", F.explode(each))
    return rows.groupBy(*by, F.col("q.nominal").alias("nominal")).agg(F.avg(F.coalesce(C.nan_to_null(F.col("truth")) <= C.nan_to_null(F.col("q.bar")), F.lit(False)).cast("double")).alias("observed"))


def fair_crps_loss(points: DataFrame, by=SCORE) -> DataFrame:
    """Mean fair CRPS weighted by cosine of latitude over its mean; fewer than two members raise when computed."""
    enough = F.when(F.size("members") >= 2, F.col("members")).otherwise(F.raise_error(F.lit("fair CRPS needs two members or more")).cast("array<double>"))
    rows = points.withColumn("c", crps(enough, F.col("truth"), fair=True))
    lat = rows.groupBy(*by, "lat").agg(F.sum("c").alias("s"), F.count("c").alias("n")).withColumn("w", C.lat_weight(F.col("lat")))
    return lat.groupBy(*by).agg((F.sum(F.col("s") * F.col("w")) / F.avg("w") / F.nullif(F.sum("n"), F.lit(0))).alias("fair_crps"))


def weighted_mse(pairs: DataFrame, by=SCORE) -> DataFrame:
    """Mean of (f - o) squared, weighted by cosine of latitude over its mean."""
    scores = pair_scores(pairs, "normalized", by)
    return scores.select(*by, F.pow("rmse", 2).alias("mse"))


def gate(scores: DataFrame, leads, metric: str = "crpss_vs_prob", threshold: float = 0.0) -> DataFrame:
    """passed: whether the metric exceeds the threshold at all the given leads; false without rows."""
    ok = F.coalesce(F.col(metric) > threshold, F.lit(False))
    return scores.where(F.col("lead").isin(*leads)).agg(F.coalesce(F.bool_and(ok), F.lit(False)).alias("passed"))


def event_points(points: DataFrame, physical: DataFrame | None, events) -> DataFrame:
    """event, p, y: probability and outcome of each event at each point with a truth.

    points: members and truth as anomalies; physical: the same in physical units, needed for events of that space.
    """
    out = None
    for space in ("anomaly", "physical"):
        some = [e for e in events if e.space == space]
        if not some:
            continue
        rows = points if space == "anomaly" else physical
        if rows is None:
            raise ValueError("events in physical space need physical points")
        each = F.array(*[
            F.when(F.col("variable") == e.variable, F.struct(F.lit(e.name).alias("event"), event_probability(F.col("members"), e.threshold, e.comparison).alias("p"), event(F.col("truth"), e.threshold, e.comparison).alias("y")))
            for e in some
        ])
        part = rows.where(C.finite(F.col("truth")) & F.col("variable").isin(*{e.variable for e in some})).select(F.explode(F.filter(each, lambda x: x.isNotNull())).alias("e")).select("e.*")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no events")
    return out
