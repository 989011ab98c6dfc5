"""The data cube as a long table: variable, cell_id, lat, lon, time, value (null: missing).

Daily aggregation bounds what a (variable, cell) can hold by the number of days, whatever the number of
raw rows behind a day; the window operators partition by such keys only after it.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillcube.config import PRECIPITATION, Config
from skillcube.functions import columns as C

STEP_HOURS = 6
#: Plausible ranges by variable: closed lower, open upper bound.
RANGES = {"2m_temperature": (180.0, 340.0), PRECIPITATION: (-1e-6, float("inf"))}


def read_cube(spark: SparkSession, path: str, cfg: Config | None = None, split: str | None = None) -> DataFrame:
    """A stored cube; variables, years and split reach the scan as filters."""
    try:
        cube = spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"{path} not found: build it with skillcube.jobs.build") from error
        raise
    if split is not None:
        cube = cube.where(F.col("split") == split)
    if cfg is not None:
        cube = years(select_variables(cube, cfg.input_vars), cfg.dev_years)
    return cube


def write_cube(cube: DataFrame, path: str, by: str | None = "split") -> None:
    w = cube.write.mode("overwrite")
    (w.partitionBy(by) if by else w).parquet(path)


def select_variables(cube: DataFrame, names) -> DataFrame:
    """The named variables only; use `require` to insist on their presence."""
    return cube.where(F.col("variable").isin(*names))


def require(cube: DataFrame, names) -> DataFrame:
    """select_variables, raising KeyError for a name without rows."""
    found = {r["variable"] for r in select_variables(cube, names).select("variable").distinct().collect()}
    if missing := sorted(set(names) - found):
        raise KeyError(f"variables not in the cube: {missing}")
    return select_variables(cube, names)


def flatten_levels(levelled: DataFrame, wanted) -> DataFrame:
    """Rows of (variable, level) pairs in `wanted`, with the variable named <variable>_<level>."""
    keep = F.lit(False)
    for variable, levels in wanted:
        keep |= (F.col("variable") == variable) & F.col("level").isin(*levels)
    return levelled.where(keep).withColumn("variable", F.concat_ws("_", "variable", "level")).drop("level")


def years(cube: DataFrame, span: tuple[int, int] | None) -> DataFrame:
    """Whole years, closed; a range on time, which a Parquet scan can use."""
    if span is None:
        return cube
    lo, hi = F.lit(datetime(span[0], 1, 1)), F.lit(datetime(span[1] + 1, 1, 1))
    return cube.where((F.col("time") >= lo) & (F.col("time") < hi))


def clean(cube: DataFrame) -> DataFrame:
    return cube.withColumn("value", C.nan_to_null(F.col("value")))


def time_steps(cube: DataFrame) -> DataFrame:
    """How often each difference of successive times occurs: (step_seconds, n).

    Distinct times come first; they are numbered by day and joined with the next day's first, so the
    order needs no single task.
    """
    from pyspark.sql import Window

    at = cube.select(F.unix_timestamp(F.col("time").cast("timestamp")).alias("at")).distinct().withColumn("day", F.floor(F.col("at") / 86400))
    w = Window.partitionBy("day").orderBy("at")
    rows = at.withColumn("next", F.lead("at").over(w))
    first = at.groupBy("day").agg(F.min("at").alias("first"))
    # days without rows in between: the next day that has some
    days = first.withColumn("following", F.lead("first").over(Window.orderBy("day")))
    steps = rows.join(days.select("day", "following"), "day").select((F.coalesce("next", "following") - F.col("at")).alias("step_seconds"))
    return steps.where("step_seconds is not null").groupBy("step_seconds").agg(F.count(F.lit(1)).alias("n"))


def summary(cube: DataFrame) -> DataFrame:
    """Per variable: rows, missing, cells, times, least and largest value."""
    return cube.groupBy("variable").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").isNull()).alias("n_missing"), F.countDistinct("cell_id").alias("cells"),
        F.min("time").alias("first"), F.max("time").alias("last"), F.min("value").alias("least"), F.max("value").alias("largest"),
    )


def verify(cube: DataFrame, n_lat: int = 32, n_lon: int = 64, step_hours: int = STEP_HOURS) -> DataFrame:
    """Raises ValueError unless grid, cadence and ranges are as they should be; returns the summary."""
    grid = cube.agg(F.countDistinct("lat").alias("lats"), F.countDistinct("lon").alias("lons"), F.max(F.abs("lat")).alias("pole")).first()
    if (grid["lats"], grid["lons"]) != (n_lat, n_lon):
        raise ValueError(f"grid is {grid['lats']} x {grid['lons']}, not {n_lat} x {n_lon}")
    if grid["pole"] >= 90:
        raise ValueError("the grid includes a pole")
    steps = [r["step_seconds"] for r in time_steps(cube).limit(10).collect()]
    if steps != [step_hours * 3600]:
        raise ValueError(f"time steps are {steps} s, not {step_hours} h throughout")
    out = summary(cube)
    for r in out.where(F.col("variable").isin(*RANGES)).collect():
        lo, hi = RANGES[r["variable"]]
        if r["least"] is not None and not (lo <= r["least"] and r["largest"] < hi):
            raise ValueError(f"{r['variable']} runs from {r['least']} to {r['largest']}")
    return out


def daily_mean(cube: DataFrame) -> DataFrame:
    """Means by day, missing values skipped."""
    return cube.groupBy("variable", "cell_id", "lat", "lon", F.to_date("time").alias("time")).agg(F.avg("value").alias("value"))


def grid(cube: DataFrame) -> DataFrame:
    return cube.select("cell_id", "lat", "lon").distinct()


def from_orders(spark: SparkSession, sf_dir: str, cells: int = 25) -> DataFrame:
    """A daily cube out of order lines: cells are the suppliers' nations (modulo `cells`), values daily means.

    Quantity stands for a signed field, discount for precipitation.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_shipdate", "l_quantity", "l_discount")
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_nationkey") % cells).cast("int").alias("cell_id"))
    days = lines.join(suppliers, "l_suppkey").groupBy("cell_id", F.to_date("l_shipdate").alias("time")).agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias(PRECIPITATION))
    long = days.unpivot(["cell_id", "time"], ["quantity", PRECIPITATION], "variable", "value")
    return clean(long).select("variable", "cell_id", (F.col("cell_id") * 5.0 - 60.0).alias("lat"), ((F.col("cell_id") * 37) % 360).cast("double").alias("lon"), "time", "value")


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 6-hourly cube of one cell out of events: variables are the event types."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value")
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    bin_ = F.timestamp_seconds(at - at % (STEP_HOURS * 3600)).cast("timestamp_ntz")
    means = e.groupBy(F.col("event_type").alias("variable"), bin_.alias("time")).agg(F.avg(C.nan_to_null(F.col("value"))).alias("value"))
    return means.select("variable", F.lit(0).alias("cell_id"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), "time", "value")
