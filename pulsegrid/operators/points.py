"""Point facts: coverage by weeks, losses, and when sources were last seen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.functions.limits import LOSS_IDS
from pulsegrid.functions.scalars import week_start


def split_covered(points: DataFrame, weeks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points in weeks that exist, points without one); a range test made an equality on the week."""
    dated = points.withColumn("week", week_start(F.col("ts")))
    known = weeks.select(F.col("week").cast("timestamp").alias("week")).distinct()
    return dated.join(known, "week", "left_semi"), dated.join(known, "week", "left_anti")


def loss_summary(lost: DataFrame, by: list[str]) -> DataFrame:
    """Lost points by group: count, first and last ts, distinct series, and the smallest series ids.

    Ids are made distinct and ranked before they are gathered, so no group holds more than a few.
    """
    sums = lost.groupBy(*by).agg(F.count(F.lit(1)).alias("points"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    ids = lost.select(*by, "series_id").distinct()
    counts = ids.groupBy(*by).agg(F.count("series_id").alias("series"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("series_id"))
    least = ids.withColumn("_n", rank).where(F.col("_n") <= LOSS_IDS).groupBy(*by).agg(F.array_sort(F.collect_list("series_id")).alias("series_ids"))
    return sums.join(counts, by).join(least, by)


def dropped_by_reason(rejects: DataFrame) -> DataFrame:
    """Points lost by reason; counts of none or less are left out."""
    return rejects.where("n_points > 0").groupBy("reason").agg(F.sum("n_points").alias("points"))


def last_seen(batches: DataFrame, mode: str = "last") -> DataFrame:
    """Per source the last time stamp of its batches (source_id, received_at, batch_id, points).

    mode "last": the batch that came last decides, so a replay can set the time back; "max": the latest stamp.
    """
    latest = batches.select("source_id", "received_at", "batch_id", F.array_max(F.transform("points", lambda p: F.try_to_timestamp(p["ts"]))).alias("ts"))
    if mode == "max":
        return latest.groupBy("source_id").agg(F.max("ts").alias("last_seen_at"))
    if mode != "last":
        raise ValueError(f"unknown mode {mode!r}")
    return latest.groupBy("source_id").agg(F.max_by("ts", F.struct("received_at", "batch_id")).alias("last_seen_at"))


def touch_sources(sources: DataFrame, seen: DataFrame) -> DataFrame:
    s = seen.select(F.col("source_id").alias("id"), F.col("last_seen_at").alias("_seen"))
    return sources.join(s, "id", "left").withColumn("last_seen_at", F.coalesce("_seen", "last_seen_at")).select(*sources.columns)
