"""Rollups at rest, kept up to date by what has come in: only touched minutes and hours are computed again.

Beside the points lie minutes and hours by week, in the same log. A refresh looks at the folders of points that were
committed after the last one. The (series, minute) pairs in them, late ones too, are computed anew from all their
points, and the hours they are in from their minutes. Points and minutes are marked as new or old as they are read and
grouped once; a group without a new row is left out, so that nothing is joined to find the touched ones. Rows carry the version they were made from; the latest counts.
A refresh that is run again finds nothing new, and points that come twice are counted as they are stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import limits as lim
from pulsegrid.functions.scalars import week_start
from pulsegrid.operators.rollup import rollup_1h, rollup_1m
from pulsegrid.sources.log import State, commit, read_folders, read_state
from pulsegrid.sources.tables import add_points, add_weeks, read_facts, week_of

VALUES = ["n", "total", "least", "most", "last"]


def latest(rows: DataFrame, *rest: str) -> DataFrame:
    """Of rows of a rollup (with version) the latest of each series and bucket; rest: further columns, version or what follows from the bucket."""
    by = [c for c in rest if c != "version"]
    newest = rows.groupBy("series_id", *by, "bucket").agg(F.max_by(F.struct(*VALUES), "version").alias("v"), F.max("version").alias("version"))
    return newest.select("series_id", "bucket", *[f"v.{c}" for c in VALUES], *rest)


def stored_rollup(spark: SparkSession, path: str, table: str, state: State | None = None, weeks: set[str] | None = None) -> DataFrame:
    """series_id, bucket, n, total, least, most and last of minutes or hours; of some weeks only, if they are given."""
    state = read_state(spark, path) if state is None else state
    folders = [f for f in state.folders(table) if weeks is None or week_of(f) in weeks]
    return latest(read_folders(spark, path, state, table, lim.ROLLUP, folders))


def refresh_rollups(spark: SparkSession, path: str) -> int:
    """Brings minutes and hours up to date with the points, in one commit; the number of minutes that were computed again."""
    state = read_state(spark, path)
    fresh = state.since("points", state.facts.get("rolled", -1))
    if not fresh:
        return 0
    weeks = {week_of(f) for f in fresh}
    minute, hour = F.date_trunc("minute", "ts"), F.date_trunc("hour", "bucket")
    stored = [f for f in state.folders("points") if week_of(f) in weeks and f not in set(fresh)]
    of = lambda folders, new: read_facts(spark, path, folders).select("series_id", "ts", "value", F.lit(new).alias("new"))
    points = of(fresh, True).unionByName(of(stored, False)) if stored else of(fresh, True)
    dated = lambda rows: rows.withColumn("version", F.lit(state.version).cast("long")).withColumn("week", week_start(F.col("bucket")).cast("date"))
    seen = Observation()
    touched = rollup_1m(points, F.bool_or("new").alias("new")).where("new").drop("new").observe(seen, F.count(F.lit(1)).alias("minutes"))
    minutes = add_weeks(dated(touched), path, "minutes")
    # an hour lies in one week, as its minutes do; it is the part of the key by which minutes are dealt out, for both steps
    after = state.after(state.version, {"add": {"minutes": minutes}})
    rows = read_folders(spark, path, after, "minutes", lim.ROLLUP, [f for f in after.folders("minutes") if week_of(f) in weeks])
    dealt = rows.withColumn("hour", hour).repartition("series_id", "hour")
    inside = latest(dealt, "hour", "version").withColumn("new", F.col("version") == state.version)
    made = add_weeks(dated(rollup_1h(inside.drop("version"), F.bool_or("new").alias("new")).where("new").drop("mean", "new")), path, "hours")
    commit(spark, path, state, {"add": {"minutes": minutes, "hours": made}, "facts": {"rolled": state.version}})
    return seen.get["minutes"]


def compact_rollups(spark: SparkSession, path: str) -> int:
    """Of each week's rollups the latest rows alone stay, in one folder; the number of folders that went."""
    gone = 0
    for table in ("minutes", "hours"):
        state, by_week = read_state(spark, path), {}
        for f in state.folders(table):
            by_week.setdefault(week_of(f), []).append(f)
        old = [f for found in by_week.values() if len(found) > 1 for f in found]
        if old:
            rows = latest(read_folders(spark, path, state, table, lim.ROLLUP, old)).withColumn("version", F.lit(state.facts.get("rolled", -1)).cast("long"))
            new = add_weeks(rows.withColumn("week", week_start(F.col("bucket")).cast("date")), path, table)
            commit(spark, path, state, {"remove": {table: old}, "add": {table: new}})
            gone += len(old) - len(new)
    return gone


def roll_in(points: DataFrame, path: str, stream: str, epoch: int) -> int:
    """A micro-batch of points (series_id, ts, value): stored once, whatever the number of tries, and rolled up; the minutes computed again."""
    spark = points.sparkSession
    state = read_state(spark, path)
    done = state.streams.get(stream)
    if not done or epoch > done["epoch"]:
        folders, rows = add_points(points, path)
        commit(spark, path, state, {"stream": stream, "epoch": epoch, "rows": rows, "add": {"points": folders}})
    return refresh_rollups(spark, path)
