"""Rollups of points (an extension)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rollup_1m(points: DataFrame, *more: Column) -> DataFrame:
    """Minutes from points; more: further aggregates of them."""
    g = points.groupBy("series_id", F.date_trunc("minute", "ts").alias("bucket"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"), F.max_by("value", F.struct("ts", "value")).alias("last"), *more)


def rollup_1h(minutes: DataFrame, *more: Column) -> DataFrame:
    """Hours from minutes: sums of sums, and the mean from both. An hour that minutes already have is used; more: further aggregates."""
    g = minutes.groupBy("series_id", "hour" if "hour" in minutes.columns else F.date_trunc("hour", "bucket").alias("hour"))
    out = g.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"), F.max_by("last", "bucket").alias("last"), *more)
    return out.withColumnRenamed("hour", "bucket").withColumn("mean", F.col("total") / F.col("n"))
