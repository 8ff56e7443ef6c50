"""Spooled batches of hosts: what is kept, what comes first, and their replay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.functions.limits import SPOOL_DEPTH, WIRE_REQUEST
from pulsegrid.functions.scalars import spool_parked_at


def spool_evict(files: DataFrame, most: int = SPOOL_DEPTH) -> DataFrame:
    """files (host, file_name, and in_flight if there is such a column) that stay: the newest most of each host.

    A file in flight counts but always stays. Without such a column Spark limits the groups before the shuffle,
    if spark.sql.optimizer.windowGroupLimitThreshold is at least most.
    """
    newest = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("file_name")))
    keep = F.col("_n") <= most
    keep = keep | F.coalesce("in_flight", F.lit(False)) if "in_flight" in files.columns else keep
    return files.withColumn("_n", newest).where(keep).drop("_n")


def spool_oldest(files: DataFrame) -> DataFrame:
    return files.groupBy("host").agg(F.min("file_name").alias("file_name")).withColumn("parked_at", spool_parked_at(F.col("file_name")))


def spool_replay(files: DataFrame, most: int = SPOOL_DEPTH) -> DataFrame:
    """Requests of the files (host, file_name, payload) that stay, numbered from the oldest of each host."""
    kept = spool_evict(files, most)
    nth = F.row_number().over(Window.partitionBy("host").orderBy("file_name"))
    body = F.from_json("payload", WIRE_REQUEST)
    out = kept.withColumn("nth", nth).withColumn("b", body).select("host", "file_name", "nth", spool_parked_at(F.col("file_name")).alias("parked_at"), "b.source", "b.points")
    return out.sortWithinPartitions("host", "nth")


def spool_requests(files: DataFrame) -> DataFrame:
    """host, file_name, parked_at, source and points of files (host, file_name, payload), in any number and order, as of a stream."""
    return files.withColumn("b", F.from_json("payload", WIRE_REQUEST)).select("host", "file_name", spool_parked_at(F.col("file_name")).alias("parked_at"), "b.source", "b.points")
