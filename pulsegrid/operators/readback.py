"""Reading points back by tenant, source and series."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def points_per_series(points: DataFrame) -> DataFrame:
    return points.groupBy("series_id").agg(F.count(F.lit(1)).alias("points"))


def points_per_tenant(points: DataFrame, series: DataFrame) -> DataFrame:
    """Counts by tenant; facts are added up by series before they meet the dimension."""
    s = series.select(F.col("id").alias("series_id"), "tenant_id")
    return points_per_series(points).join(s, "series_id").groupBy("tenant_id").agg(F.sum("points").alias("points"))


def points_by_source(points: DataFrame, series: DataFrame, sources: DataFrame) -> DataFrame:
    s = series.select(F.col("id").alias("series_id"), "source_id")
    by_source = points_per_series(points).join(s, "series_id").groupBy("source_id").agg(F.sum("points").alias("points"))
    return by_source.join(sources.select(F.col("id").alias("source_id"), "tenant_id", F.col("name").alias("source")), "source_id")


def latest_points(points: DataFrame, k: int = 1, ties: list[str] | None = None) -> DataFrame:
    """The k latest points of each series; Spark limits the groups before it shuffles them."""
    order = Window.partitionBy("series_id").orderBy(F.desc("ts"), *[F.desc(c) for c in ties or ["value"]])
    return points.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def read_points(points: DataFrame, series: DataFrame, sources: DataFrame, tenant_id: int, start: dt.datetime, end: dt.datetime, source: str | None = None, name: str | None = None) -> DataFrame:
    """Points of a tenant from start to before end, latest first; weeks outside are pruned (extension)."""
    monday = (start - dt.timedelta(days=start.weekday())).replace(hour=0, minute=0, second=0, microsecond=0)
    s = series.where(F.col("tenant_id") == tenant_id)
    s = s.where(F.col("name") == name) if name is not None else s
    src = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    src = src.where(F.col("source") == source) if source is not None else src
    dim = s.join(src, "source_id").select(F.col("id").alias("series_id"), "source", "name", "unit", "labels")
    inside = points.where((F.col("week") >= F.lit(monday)) & (F.col("week") < F.lit(end)) & (F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end)))
    return inside.join(dim, "series_id").select("source", "name", "unit", "labels", "ts", "value").orderBy(F.desc("ts"), "source", "name", "labels", "value")
