"""Builds the processed tables: anomalies by split, climatology, normalizer."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skillcube.config import Config
from skillcube.operators import climatology, splits, windows
from skillcube.sources import cube


@dataclass(frozen=True)
class Built:
    tagged: DataFrame
    anomalies: DataFrame
    climatology: DataFrame
    norm: DataFrame

    def release(self) -> None:
        for df in (self.anomalies, self.climatology, self.tagged):
            df.unpersist()


def build(daily: DataFrame, cfg: Config, missing: str = "raise") -> Built:
    """From a daily cube, the climatology fitted on the training block.

    Scores read the anomalies several times (series, spine, weeks), and the climatology reads the daily
    cube once more, so these are kept in memory and on disk when first computed: the raw rows behind the
    daily means are scanned once. Lost blocks are computed again. `write` stores them for other jobs.
    """
    tagged = splits.tagged(daily, cfg.splits).persist()
    clim = climatology.fit(tagged, cfg.climatology_smooth_days).persist()
    anomalies = climatology.anomaly(tagged, clim, missing).persist()
    return Built(tagged, anomalies, clim, climatology.normalizer(anomalies))


def write(built: Built, folder: str) -> None:
    built.anomalies.write.mode("overwrite").partitionBy("split").parquet(f"{folder}/anomalies")
    built.climatology.write.mode("overwrite").parquet(f"{folder}/climatology")
    built.norm.write.mode("overwrite").parquet(f"{folder}/norm")


def load(spark: SparkSession, folder: str) -> Built:
    """What `write` stored; FileNotFoundError if it isn't there."""
    anomalies, clim, norm = (cube.read_cube(spark, f"{folder}/{name}") for name in ("anomalies", "climatology", "norm"))
    return Built(anomalies, anomalies, clim, norm)


def samples(anomalies: DataFrame, norm: DataFrame, cfg: Config, split: str) -> DataFrame:
    """Model samples of a split, each of cfg.channels by cells: strided daily inits for train and val, Monday inits for test."""
    z = climatology.standardize(splits.only(anomalies, split), norm)
    weeks, lead = cfg.history_weeks, max(cfg.lead_weeks)
    if split == "test":
        spine = windows.weekly_spine(windows.weekly_mean(z), cfg.input_vars)
        w = windows.weekly_windows(windows.require_length(spine, "week", weeks + lead), weeks, cfg.lead_weeks)
    else:
        w = windows.daily_windows(windows.daily_spine(z, cfg.input_vars), weeks, cfg.lead_weeks, cfg.train_stride_days)
        w = windows.inside_blocks(w, cfg.splits, 7 * (weeks - 1) + 6, 7 * lead + 6)
    return windows.samples(w, cfg)


@dataclass(frozen=True)
class Data:
    """What a fit reads: the grid in order of the samples' cells, channels, normalizer, and samples of the three splits."""

    cell_id: np.ndarray
    lat: np.ndarray
    lon: np.ndarray
    target_vars: tuple[str, ...]
    channels: tuple[int, int]
    norm: DataFrame
    train: DataFrame
    val: DataFrame
    test: DataFrame

    @property
    def grid(self) -> tuple[int, int]:
        """Latitudes and longitudes."""
        return len(set(self.lat)), len(set(self.lon))

    def cell_weights(self) -> np.ndarray:
        """Cosine of each cell's latitude over its mean of the latitudes."""
        return np.cos(np.radians(self.lat)) / np.cos(np.radians(sorted(set(self.lat)))).mean()


def data(built: Built, cfg: Config) -> Data:
    """The samples of what was built, with grid and normalizer; cells (a row each, of one grid) come to the driver."""
    cells = built.anomalies.where(F.col("variable").isin(*cfg.input_vars)).select("cell_id", "lat", "lon").distinct().orderBy("lat", "lon").toArrow()
    grid = [cells.column(c).to_numpy() for c in ("cell_id", "lat", "lon")]
    parts = [samples(built.anomalies, built.norm, cfg, split) for split in ("train", "val", "test")]
    return Data(*grid, cfg.target_vars, cfg.channels, built.norm, *parts)


def stored(data: Data, folder: str, splits: tuple[str, ...] = ("train", "val", "test")) -> Data:
    """data with its samples of `splits` written under folder and read back: a fit reads them each epoch, so they are made once, not again for each fit or forecast."""
    kept = {}
    for split in splits:
        samples = getattr(data, split)
        samples.write.parquet(f"{folder}/{split}")
        kept[split] = samples.sparkSession.read.schema(samples.schema).parquet(f"{folder}/{split}")
    return replace(data, **kept)


def shuffled(samples: DataFrame, seed: int, epoch: int = 0) -> DataFrame:
    """Samples in an order of their own for each (seed, epoch), as `place` (from 0), the same however they are stored.

    A row per init, so the numbering is a window over as many rows as there are days.
    """
    by = [c for c in ("split",) if c in samples.columns]
    order = Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), F.lit(epoch), "init"), "init")
    places = samples.select(*by, "init").withColumn("place", F.row_number().over(order) - 1)
    return samples.join(places, [*by, "init"])


def batches(samples: DataFrame, size: int) -> DataFrame:
    """`batch`: consecutive places in batches of `size`, the last one shorter."""
    return samples.withColumn("batch", F.floor(F.col("place") / size).cast("int"))
