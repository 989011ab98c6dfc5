"""Cross-validation by folds of years: climatology and normalizer of all folds but one, for each fold, out of one scan.

The scan sums values and squares by cell, day of the year and fold. What a fold is judged by is the total less its own sums, so the
raw rows aren't read again for each fold, and what is derived has a row per fold, cell and day of the year at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillcube.functions import columns as C
from skillcube.operators import climatology

CELL = climatology.CELL


def by_year(day: Column, folds: int | None = None) -> Column:
    """The fold of a day: its year, or with `folds` the year's remainder, so that neighbouring years are in different ones."""
    return F.year(day) if folds is None else F.pmod(F.year(day), F.lit(folds))


def sums(cube: DataFrame, fold: Column) -> DataFrame:
    """variable, cell_id, doy, fold, n, s, q: counts, sums and squares of values (log1p for precipitation), missing ones left out."""
    value = C.log1p_precipitation(F.col("variable"), F.col("value"))
    rows = cube.where(C.finite(F.col("value"))).select(*CELL, F.dayofyear("time").alias("doy"), fold.alias("fold"), value.alias("v"))
    return rows.groupBy(*CELL, "doy", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))


def left_out(sums: DataFrame) -> DataFrame:
    """The same columns with each fold's sums those of all other folds, where there is a row left.

    The parts of a cell and day (as many as folds) meet in one row, and each fold takes what isn't its own.
    """
    parts = sums.groupBy(*CELL, "doy").agg(F.collect_list(F.struct("fold", "n", "s", "q")).alias("p"))
    folds = F.broadcast(sums.select("fold").distinct().agg(F.array_sort(F.collect_set("fold")).alias("folds")))  # one row, a number per fold

    def others(fold):
        kept = F.array_sort(F.filter("p", lambda x: x.fold != fold))
        total = lambda name: F.aggregate(F.transform(kept, lambda x: x[name].cast("double")), F.lit(0.0), lambda a, x: a + x)
        return F.struct(fold.alias("fold"), total("n").cast("long").alias("n"), total("s").alias("s"), total("q").alias("q"))

    rows = parts.join(folds).select(*CELL, "doy", F.explode(F.transform("folds", others)).alias("o"))
    return rows.select(*CELL, "doy", "o.fold", "o.n", "o.s", "o.q").where("n > 0")


def climatologies(rest: DataFrame, window: int) -> DataFrame:
    """fold, variable, cell_id, doy, clim: the smoothed climatology of all folds but that one, from left_out's rows."""
    return climatology.smooth(rest.select("fold", *CELL, "doy", (F.col("s") / F.col("n")).alias("raw")), window, ("fold",))


def normalizers(rest: DataFrame, clims: DataFrame) -> DataFrame:
    """fold, variable, mean, std of the anomalies of all folds but that one from their own climatology.

    The sums of x - c and of its square are n, s and q less what a constant c takes from them.
    """
    rows = rest.join(clims, ["fold", *CELL, "doy"])
    n, s, q, c = (F.col(k) for k in ("n", "s", "q", "clim"))
    off = rows.groupBy("fold", "variable").agg(F.sum("n").alias("n"), F.sum(s - n * c).alias("s"), F.sum(q - 2 * c * s + n * c * c).alias("q"))
    mean = F.col("s") / F.col("n")
    return off.select("fold", "variable", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"))


def anomalies(cube: DataFrame, fold: Column, clims: DataFrame) -> DataFrame:
    """The cube with `fold`, values as anomalies from the climatology of the other folds; null on days that these don't have."""
    rows = cube.withColumn("fold", fold).withColumn("doy", F.dayofyear("time")).join(clims, ["fold", *CELL, "doy"], "left")
    return rows.withColumn("value", C.log1p_precipitation(F.col("variable"), F.col("value")) - F.col("clim")).drop("clim", "doy")


def scores(out: DataFrame, norms: DataFrame) -> DataFrame:
    """fold, variable, n, rmse, relative: how far the days of a fold lie from the climatology of the others, and over their deviation."""
    rows = out.where(C.finite(F.col("value"))).groupBy("fold", "variable").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rmse"))
    return rows.join(norms, ["fold", "variable"]).select("fold", "variable", "n", "rmse", (F.col("rmse") / F.nullif("std", F.lit(0.0))).alias("relative"))
