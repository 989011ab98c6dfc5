"""Leakage-safe splits by year, with an embargo at the end of each block but the last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillcube.config import Splits


def split_of(day: Column, splits: Splits) -> Column:
    """train, val or test; null in an embargo and outside the blocks."""
    out = F.lit(None).cast("string")
    for name, lo, hi in reversed(splits.blocks()):
        out = F.when(day.between(F.lit(lo), F.lit(hi)), name).otherwise(out)
    return out


def tagged(cube: DataFrame, splits: Splits, keep_embargo: bool = False) -> DataFrame:
    """The cube with a split column, in one pass; embargo days are dropped unless asked for."""
    out = cube.withColumn("split", split_of(F.col("time").cast("date"), splits))
    return out if keep_embargo else out.where("split is not null")


def only(cube: DataFrame, split: str) -> DataFrame:
    return cube.where(F.col("split") == split)


def census(cube: DataFrame) -> DataFrame:
    """Days and rows by split."""
    return cube.groupBy("split").agg(F.countDistinct("time").alias("days"), F.count(F.lit(1)).alias("n"))


def months_mean(cube: DataFrame, months=(6, 7, 8, 9)) -> DataFrame:
    """Unweighted mean per split and variable over the given months."""
    return cube.where(F.month("time").isin(*months)).groupBy("split", "variable").agg(F.avg("value").alias("mean"))
