"""Weekly means, rolling means, history and lead windows. Keys hold split where there is one, so that no
window crosses a block."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillcube.config import Config
from skillcube.functions import columns as C


def _series(df: DataFrame) -> list[str]:
    return [c for c in ("split", "variable", "cell_id", "lat", "lon") if c in df.columns]


def weekly_mean(daily: DataFrame, min_days: int = 1) -> DataFrame:
    """Means of Monday-to-Sunday weeks labelled by their Monday; short weeks at the edges count."""
    week = daily.groupBy(*_series(daily), C.monday(F.col("time")).alias("week")).agg(F.avg("value").alias("value"), F.count("value").alias("days"))
    return (week.where(F.col("days") >= min_days) if min_days > 1 else week).drop("days")


def dense(rows: DataFrame, time: str, step: str, variables=None) -> DataFrame:
    """A row for each step from the first to the last time of the split, null where there was none.

    With `variables` each cell of a split has a series of each of them, so that a model's input has one shape
    whatever is missing.
    """
    keys, by = _series(rows), [c for c in ("split",) if c in rows.columns]
    ends = rows.groupBy(*by).agg(F.min(time).alias("lo"), F.max(time).alias("hi"))  # a row per split
    if variables is None:
        series = rows.select(*keys).distinct()
    else:
        rows = rows.where(F.col("variable").isin(*variables))
        series = rows.select(*[k for k in keys if k != "variable"]).distinct().withColumn("variable", F.explode(F.array(*map(F.lit, variables)))).select(*keys)
    spine = series.join(F.broadcast(ends), by) if by else series.join(F.broadcast(ends))
    spine = spine.withColumn(time, F.explode(F.sequence("lo", "hi", F.expr(f"interval {step}")))).drop("lo", "hi")
    return spine.join(rows, [*keys, time], "left")


def weekly_spine(weekly: DataFrame, variables=None) -> DataFrame:
    return dense(weekly, "week", "7 days", variables)


def daily_spine(daily: DataFrame, variables=None) -> DataFrame:
    return dense(daily, "time", "1 day", variables)


def require_length(spine: DataFrame, time: str, least: int) -> DataFrame:
    """The spine; raises ValueError if a block has fewer steps than a window takes."""
    by = [c for c in ("split",) if c in spine.columns]
    for r in spine.groupBy(*by).agg(F.countDistinct(time).alias("n")).collect():  # a row per split
        if r["n"] < least:
            raise ValueError(f"{r['split'] if by else 'the cube'} has {r['n']} steps, a window takes {least}")
    return spine


def inside_blocks(windows: DataFrame, splits, first: int, last: int) -> DataFrame:
    """The windows; one whose days, from `first` before its init to `last` after it, leave its split's block raises when computed."""
    ok = F.lit(False)
    for name, lo, hi in splits.blocks():
        ok |= (F.col("split") == name) & (F.date_sub("init", first) >= F.lit(lo)) & (F.date_add("init", last) <= F.lit(hi))
    leak = F.raise_error(F.concat(F.lit("window beyond its block: "), F.col("split"), F.lit(" "), F.col("init").cast("string")))
    return windows.withColumn("init", F.when(ok, F.col("init")).otherwise(leak.cast("date")))


def lead_targets(spine: DataFrame, leads) -> DataFrame:
    """init, lead, truth: the week `lead` weeks on; null past the end. spine: dense weeks."""
    keys = _series(spine)
    w = Window.partitionBy(*keys).orderBy("week")
    ahead = F.array(*[F.struct(F.lit(k).alias("lead"), F.lead("value", k).over(w).alias("truth")) for k in leads])
    return spine.withColumn("ahead", ahead).withColumn("t", F.explode("ahead")).select(*keys, F.col("week").alias("init"), F.col("value").alias("current"), "t.lead", "t.truth")


def valid_inits(spine: DataFrame, max_lead: int) -> DataFrame:
    """Weeks with `max_lead` more weeks after them."""
    if max_lead <= 0:
        return spine
    keys = _series(spine)
    return spine.withColumn("_after", F.lead("week", max_lead).over(Window.partitionBy(*keys).orderBy("week"))).where("_after is not null").drop("_after")


def history(spine: DataFrame, weeks: int) -> DataFrame:
    """history: the values of the `weeks` weeks up to and with each one, oldest first."""
    w = Window.partitionBy(*_series(spine)).orderBy("week")
    return spine.withColumn("history", F.array(*[F.lag("value", k).over(w) for k in range(weeks - 1, -1, -1)]))


def weekly_windows(spine: DataFrame, history_weeks: int, leads) -> DataFrame:
    """init, history and targets arrays for each week with a full history and all leads in range."""
    keys = _series(spine)
    w, whole = Window.partitionBy(*keys).orderBy("week"), Window.partitionBy(*keys)
    rows = spine.withColumn("_at", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(whole))
    rows = rows.withColumn("history", F.array(*[F.lag("value", k).over(w) for k in range(history_weeks - 1, -1, -1)]))
    rows = rows.withColumn("targets", F.array(*[F.lead("value", k).over(w) for k in leads]))
    ok = (F.col("_at") >= history_weeks - 1) & (F.col("_at") < F.col("_n") - max(leads))
    return rows.where(ok).select(*keys, F.col("week").alias("init"), "history", "targets")


def rolling7(spine: DataFrame) -> DataFrame:
    """Mean of the seven days up to each day, null unless all seven have values. spine: dense days."""
    w = Window.partitionBy(*_series(spine)).orderBy("time").rowsBetween(-6, 0)
    return spine.withColumn("rolled", F.when(F.count("value").over(w) == 7, F.avg("value").over(w)))


def daily_windows(spine: DataFrame, history_weeks: int, leads, stride: int = 1) -> DataFrame:
    """Windows of rolling means with an init each `stride` days (no rows where a block is too short).

    With t the init day, history week h is the mean that ends on t - 7 (history_weeks - 1 - h), lead L
    the mean of days t + 7 L to t + 7 L + 6.
    """
    keys = _series(spine)
    w, whole = Window.partitionBy(*keys).orderBy("time"), Window.partitionBy(*keys)
    rows = rolling7(spine).withColumn("_at", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(whole))
    rows = rows.withColumn("history", F.array(*[F.lag("rolled", 7 * k).over(w) for k in range(history_weeks - 1, -1, -1)]))
    rows = rows.withColumn("targets", F.array(*[F.lead("rolled", 7 * k + 6).over(w) for k in leads]))
    first = 7 * (history_weeks - 1) + 6  # the oldest mean ends on the block's seventh day at least
    ok = (F.col("_at") >= first) & (F.col("_at") <= F.col("_n") - 7 * max(leads) - 7) & ((F.col("_at") - first) % stride == 0)
    return rows.where(ok).select(*keys, F.col("time").alias("init"), "history", "targets")


def samples(windows: DataFrame, cfg: Config) -> DataFrame:
    """init, input and target arrays of floats for a model.

    input: per history week, oldest first, the variables in order of cfg.input_vars, each over cells in
    order of (lat, lon); then the season channel over cells. target: per lead, the target variables over
    cells. Missing inputs are 0, missing targets stay null. Each cell needs a row of each variable (see `dense`); a sample without
    raises when computed, as its channels would shift.
    """
    names = F.array(*map(F.lit, cfg.input_vars))
    by = [c for c in ("split",) if c in windows.columns]
    rows = windows.where(F.col("variable").isin(*cfg.input_vars)).withColumn("v", F.array_position(names, F.col("variable")).cast("int"))
    place = F.struct("v", "lat", "lon", "history", "targets")
    packed = rows.groupBy(*by, "init").agg(F.array_sort(F.collect_list(place)).alias("p"))  # a model's input: one row per sample
    want = F.broadcast(rows.groupBy(*by).agg((F.countDistinct("cell_id") * len(cfg.input_vars)).alias("want")))  # a row per split
    packed = packed.join(want, by) if by else packed.join(want)
    short = F.raise_error(F.concat(F.lit("series missing from the sample of "), F.col("init").cast("string"))).cast(packed.schema["p"].dataType)
    packed = packed.withColumn("p", F.when(F.size("p") == F.col("want"), F.col("p")).otherwise(short)).drop("want")
    cells = F.filter("p", lambda x: x.v == 1)
    season_ = F.transform(cells, lambda x: C.season(F.col("init")))
    outs = F.filter("p", lambda x: x.v <= len(cfg.target_vars))

    def past_week(h: int):
        return F.transform("p", lambda x: C.filled(x.history[h]).cast("float"))

    def lead_week(k: int):
        return F.transform(outs, lambda x: x.targets[k].cast("float"))

    past = F.flatten(F.array(*map(past_week, range(cfg.history_weeks))))
    ahead = F.flatten(F.array(*map(lead_week, range(len(cfg.lead_weeks)))))
    return packed.select(*by, "init", F.concat(past, season_).alias("input"), ahead.alias("target"))
