"""Weekly partitions: which to make, which to drop, and what stays of the data."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.limits import RETENTION_DAYS, TABLES, WEEKS_AHEAD
from pulsegrid.functions.scalars import parse_partition_name, partition_name, week_bounds, week_start


def known_table(table: str) -> str:
    if table not in TABLES:
        raise ValueError(f"unknown table {table!r}")
    return table


def ensure_weeks(spark: SparkSession, existing: DataFrame, as_of: dt.datetime, weeks_ahead: int = WEEKS_AHEAD, table: str = "metric_points") -> DataFrame:
    """name, week and bounds of the partitions to make, from the week of as_of on; existing has a column name."""
    known_table(table)
    first = week_start(F.lit(as_of).cast("timestamp"))
    weeks = spark.range(weeks_ahead).select((first + F.make_interval(days=(F.col("id") * 7).cast("int"))).alias("week"))
    named = weeks.select(partition_name(table, F.col("week")).alias("name"), "week", week_bounds(F.col("week")).alias("b"))
    return named.select("name", "week", "b.lower", "b.upper").join(existing.select("name"), "name", "left_anti")


def judge_partitions(names: DataFrame, as_of: dt.datetime, retention_days: int = RETENTION_DAYS, table: str = "metric_points") -> DataFrame:
    """names with week and verdict: drop (the whole week is over), keep, or unknown (not a name of ours, kept)."""
    known_table(table)
    horizon = F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(retention_days))
    week = parse_partition_name(table, F.col("name"))
    verdict = F.when(F.col("week").isNull(), "unknown").when(F.col("week") + F.expr("INTERVAL 7 DAYS") <= horizon, "drop").otherwise("keep")
    return names.select("name", week.alias("week")).withColumn("verdict", verdict)


def expired_weeks(names: DataFrame, as_of: dt.datetime, retention_days: int = RETENTION_DAYS, table: str = "metric_points") -> DataFrame:
    return judge_partitions(names, as_of, retention_days, table).where("verdict = 'drop'").select("name", "week")


def apply_retention(points: DataFrame, as_of: dt.datetime, retention_days: int = RETENTION_DAYS) -> DataFrame:
    """The points (with week) of weeks that are not over: a filter on the partition column alone."""
    limit = as_of - dt.timedelta(days=retention_days + 7)
    return points.where(F.col("week") > F.lit(limit))
