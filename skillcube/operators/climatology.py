"""Seasonal climatology, anomalies, normalization. Every statistic is fitted on rows of split `train`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillcube.functions import columns as C
from skillcube.operators.splits import only

CELL = ["variable", "cell_id"]


def doy_means(cube: DataFrame) -> DataFrame:
    """variable, cell_id, doy, raw: training means by day of the year, precipitation as log1p."""
    value = C.log1p_precipitation(F.col("variable"), F.col("value"))
    return only(cube, "train").groupBy(*CELL, F.dayofyear("time").alias("doy")).agg(F.avg(value).alias("raw"))


def smooth(raw: DataFrame, window: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Circular centred mean over `window` neighbouring days that are present (mean of daily means), per cell and `by`.

    The days of a cell are numbered in order; copies of those within the window of either end are put
    beyond the other end. An even window reaches one further back than forward.
    """
    keys = [*by, *CELL]
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("doy"))
    rows = raw.withColumn("n", n).withColumn("at", at)
    copies = F.array(
        F.col("at"),
        F.when(F.col("at") > F.col("n") - window, F.col("at") - F.col("n")),
        F.when(F.col("at") <= window, F.col("at") + F.col("n")),
    )
    ring = rows.withColumn("place", F.explode(copies)).where("place is not null")
    near = Window.partitionBy(*keys).orderBy("place").rowsBetween(-(window // 2), (window - 1) // 2)
    return ring.withColumn("clim", F.avg("raw").over(near)).where("place between 1 and n").select(*keys, "doy", "clim")


def fit(cube: DataFrame, window: int) -> DataFrame:
    return smooth(doy_means(cube), window)


def _with_clim(rows: DataFrame, clim: DataFrame, day) -> DataFrame:
    last = F.broadcast(clim.agg(F.max("doy").alias("last_doy")))  # one row
    return rows.join(last).withColumn("doy", F.least(F.dayofyear(day), F.col("last_doy"))).join(clim, [*CELL, "doy"], "left").drop("last_doy", "doy")


def anomaly(cube: DataFrame, clim: DataFrame, missing: str = "raise") -> DataFrame:
    """value minus the climatology of its day of the year (days past its last one use that one).

    A day without climatology raises when the row is computed, or gives null with missing='null'.
    """
    out = _with_clim(cube, clim, F.col("time"))
    base = F.col("clim")
    if missing == "raise":
        base = F.when(F.col("clim").isNotNull(), base).otherwise(F.raise_error(F.concat(F.lit("no climatology for "), F.col("variable"), F.lit(" on "), F.col("time").cast("string"))).cast("double"))
    return out.withColumn("value", C.log1p_precipitation(F.col("variable"), F.col("value")) - base).drop("clim")


def normalizer(anomalies: DataFrame) -> DataFrame:
    """variable, mean, std (of the population): over training days and all cells, unweighted."""
    return only(anomalies, "train").groupBy("variable").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def _scale():
    return F.when(F.col("std") > 0, F.col("std")).otherwise(1.0)


def standardize(anomalies: DataFrame, norm: DataFrame) -> DataFrame:
    return anomalies.join(F.broadcast(norm), "variable").withColumn("value", (F.col("value") - F.col("mean")) / _scale()).drop("mean", "std")  # a row per variable


def destandardize(standard: DataFrame, norm: DataFrame, column: str = "value") -> DataFrame:
    """Back to anomalies (of log1p for precipitation)."""
    return standard.join(F.broadcast(norm), "variable").withColumn(column, F.col(column) * _scale() + F.col("mean")).drop("mean", "std")


def physical(rows: DataFrame, clim: DataFrame, day: str = "time", column: str = "value") -> DataFrame:
    """Anomaly plus the climatology of `day`, precipitation back from log1p; adds `physical`."""
    out = _with_clim(rows, clim, F.col(day))
    return out.withColumn("physical", C.expm1_precipitation(F.col("variable"), F.col(column) + F.col("clim"))).drop("clim")


def physical_points(points: DataFrame, clim: DataFrame) -> DataFrame:
    """Points (members and truth as anomalies) in physical units: each with the climatology of its target week's Monday."""
    rows = _with_clim(points.withColumn("_day", F.date_add("init", F.col("lead") * 7)), clim, F.col("_day"))

    def back(x):
        return C.expm1_precipitation(F.col("variable"), x + F.col("clim"))

    return rows.withColumn("members", F.transform("members", back)).withColumn("truth", back(F.col("truth"))).drop("clim", "_day")
