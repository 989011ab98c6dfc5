"""Weekly means of a stream of cube rows, kept up to date as rows come in.

Weeks begin on Monday (windows of 7 days, 4 days after the epoch's Thursday), so means agree with operators.windows.weekly_mean. State is
a sum and a count for each open week of a series; a week closes when the watermark (the latest time seen less `delay`) passes its
end, and its state goes. Rows of a closed week are late and left out; rows out of order within the delay count. Missing values are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from skillcube.functions import columns as C

SERIES = ("variable", "cell_id", "lat", "lon")


def weekly_means(rows: DataFrame, delay: str, by: tuple[str, ...] = SERIES) -> DataFrame:
    """by, week, n, value of a stream (or a table) with time and value; n: values that came in."""
    at = rows.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", delay)
    week = F.window("time", "7 days", "7 days", "4 days")
    some = at.where(C.finite(F.col("value"))).groupBy(*by, week.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("value"))
    return some.select(*by, F.col("w.start").cast("date").alias("week"), "n", "value")


def closed_weeks(stream: DataFrame, path: str, checkpoint: str, delay: str, by: tuple[str, ...] = SERIES) -> StreamingQuery:
    """Writes each week once, when it closes, to a Parquet table: what is there is final. Takes what is available and ends."""
    out = weekly_means(stream, delay, by)
    return out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_weeks(stream: DataFrame, path: str, checkpoint: str, delay: str, by: tuple[str, ...] = SERIES) -> StreamingQuery:
    """Writes a week's mean so far whenever rows of it come in, as one folder a batch; see `latest`. A repeated batch overwrites its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    out = weekly_means(stream, delay, by)
    return out.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(table: DataFrame, by: tuple[str, ...] = SERIES) -> DataFrame:
    """The last state of each week of a table that current_weeks wrote."""
    newest = F.row_number().over(Window.partitionBy(*by, "week").orderBy(F.desc("batch")))
    return table.withColumn("_k", newest).where("_k = 1").select(*by, "week", "n", "value")
