"""Reading and writing: request bodies, spool folders, dimension tables, weekly point facts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import limits as lim
from pulsegrid.functions.scalars import week_start
from pulsegrid.operators.retention import judge_partitions
from pulsegrid.sources.log import State, commit, new_try, read_folders, read_state, written_parts


def parse_requests(bodies: DataFrame) -> DataFrame:
    """bodies (batch_id, received_at, api_key, body) with source and points in place of body; a body that is no JSON has neither."""
    return bodies.withColumn("_b", F.from_json("body", lim.WIRE_REQUEST)).select(*[c for c in bodies.columns if c != "body"], "_b.source", "_b.points")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Request logs: JSON lines of batch_id, received_at, api_key and body."""
    return parse_requests(spark.read.schema("batch_id long, received_at timestamp, api_key string, body string").json(path))


def read_spool(spark: SparkSession, path: str) -> DataFrame:
    """host, file_name and payload of spool folders, one folder per host; only *.json files, each one batch."""
    text = spark.read.text(path, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True)
    host = F.element_at(F.split("_metadata.file_path", "/"), -2)
    return text.select(host.alias("host"), F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("payload"))


def load_dims(spark: SparkSession, path: str | None = None, jdbc: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """tenants, api_keys, sources and series, from Parquet under path or over JDBC (sources/jdbc.py has its points and writes)."""
    names = {"tenants": lim.TENANT, "api_keys": lim.API_KEY, "sources": lim.SOURCE, "series": lim.SERIES}
    if jdbc:
        return {n: spark.read.format("jdbc").options(**jdbc, dbtable="metric_series" if n == "series" else n).load() for n in names}
    return {n: spark.read.schema(s).parquet(f"{path}/{n}") for n, s in names.items()}


def add_points(points: DataFrame, path: str, max_records: int = 5_000_000) -> tuple[list[str], int]:
    """Writes series_id, ts and value to folders by week that do not count yet; (the folders, number of rows).

    Nearly all rows of a stream fall in the current week. Rows are rebalanced by week: adaptive execution gives a
    small week one file, and splits a hot one into as many tasks as its size asks for. Files are sorted by series
    and time, so that their statistics serve as an index. The count comes with the write.
    """
    seen, token = Observation(), new_try()
    dated = points.select("series_id", "ts", "value", F.date_format(week_start(F.col("ts")), "yyyy-MM-dd").alias("week"))
    dealt = dated.hint("rebalance", F.col("week")).sortWithinPartitions("week", "series_id", "ts").observe(seen, F.count(F.lit(1)).alias("rows"))
    dealt.write.option("maxRecordsPerFile", max_records).partitionBy("week").parquet(f"{path}/points/{token}")
    return written_parts(points.sparkSession, path, "points", token, "week"), seen.get["rows"]


def write_points(points: DataFrame, path: str, max_records: int = 5_000_000) -> int:
    """Appends series_id, ts and value under path, by week, in one step; returns the number of rows written."""
    spark = points.sparkSession
    state = read_state(spark, path)
    folders, rows = add_points(points, path, max_records)
    if folders:
        commit(spark, path, state, {"add": {"points": folders}})
    return rows


def week_of(folder: str) -> str:
    """The Monday in the name of a folder of points, as it is written there."""
    return folder.rsplit("week=", 1)[-1]


def read_facts(spark: SparkSession, path: str, folders: list[str] | None = None) -> DataFrame:
    """Points as written, week as the Monday's time stamp; filters on week prune folders. folders: of all that count, only these."""
    facts = read_folders(spark, path, read_state(spark, path), "points", f"{lim.POINT}, week date", folders)
    return facts.select("series_id", "ts", "value", F.col("week").cast("timestamp").alias("week"))


def purge_points(spark: SparkSession, path: str, lost: DataFrame) -> list[str]:
    """Takes the points of the lost series (id) out of the table under path; returns the weeks that were written anew.

    Only weeks that hold such points are read whole. What is left of them goes to new folders, which then take the
    place of the old ones in one step; a week of which nothing is left goes. What comes to the driver is the list of
    weeks. Stored rollups of these series go in the same step.
    """
    state, gone = read_state(spark, path), lost.select(F.col("id").alias("series_id")).distinct()
    hit = read_facts(spark, path, state.folders("points")).join(gone, "series_id", "left_semi").select("week").distinct().collect()
    weeks = {f"{r['week']:%Y-%m-%d}" if r["week"] else NO_WEEK for r in hit}
    if weeks:
        old = {"points": [f for f in state.folders("points") if week_of(f) in weeks]}
        new = {"points": add_points(read_facts(spark, path, old["points"]).join(gone, "series_id", "left_anti"), path)[0]}
        for table in ("minutes", "hours"):
            if old_rows := [f for f in state.folders(table) if week_of(f) in weeks]:
                left = read_folders(spark, path, state, table, lim.ROLLUP, old_rows).join(gone, "series_id", "left_anti")
                old[table], new[table] = old_rows, add_weeks(left, path, table)
        commit(spark, path, state, {"remove": old, "add": new, "facts": still_rolled(state)})
    return sorted(weeks)


def add_weeks(rows: DataFrame, path: str, table: str) -> list[str]:
    """Writes rows with a week (date) to folders by week that do not count yet, sorted by series."""
    token = new_try()
    rows.hint("rebalance", F.col("week")).sortWithinPartitions("week", "series_id").write.partitionBy("week").parquet(f"{path}/{table}/{token}")
    return written_parts(rows.sparkSession, path, table, token, "week")


#: Fixed value: the name of the folder of points without a time.
NO_WEEK = "__HIVE_DEFAULT_PARTITION__"


def compact_points(spark: SparkSession, path: str, most: int = 1) -> list[str]:
    """Joins the folders of weeks that have more than most, so that a week of many epochs is a few large files again; returns the weeks.

    The new folders take the place of the old ones in one step. Weeks are rebalanced by their size as they are written.
    """
    state, by_week = read_state(spark, path), {}
    for f in state.folders("points"):
        by_week.setdefault(week_of(f), []).append(f)
    old = [f for found in by_week.values() if len(found) > most for f in found]
    if old:
        folders, _ = add_points(read_facts(spark, path, old), path)
        commit(spark, path, state, {"remove": {"points": old}, "add": {"points": folders}, "facts": still_rolled(state)})
    return sorted({week_of(f) for f in old})


def still_rolled(state: State) -> dict[str, int]:
    """What a commit says that moves points: where all of them have been rolled up, they still are."""
    return {} if state.since("points", state.facts.get("rolled", -1)) else {"rolled": state.version + 1}


def retire_weeks(spark: SparkSession, path: str, as_of: dt.datetime, retention_days: int = lim.RETENTION_DAYS) -> DataFrame:
    """Drops the weeks of stored points that are over, in one step; week and verdict (drop, keep, unknown) of all there were.

    No row is read: the folders of a week stop counting. Folders whose names are not those of weeks are kept and
    reported as unknown.
    """
    state = read_state(spark, path)
    weeks = sorted({week_of(f) for f in state.folders("points")})
    names = spark.createDataFrame([(w, "metric_points_" + w.replace("-", "")) for w in weeks], "folder string, name string")
    verdicts = {r["name"]: r["verdict"] for r in judge_partitions(names.select("name"), as_of, retention_days).collect()}
    judged = [(w, verdicts["metric_points_" + w.replace("-", "")]) for w in weeks]
    gone = {w for w, verdict in judged if verdict == "drop"}
    old = [f for f in state.folders("points") if week_of(f) in gone]
    if old:
        commit(spark, path, state, {"remove": {"points": old}})
    return spark.createDataFrame(judged, "week string, verdict string")


def request_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Request logs as read_requests has them, as a stream; a micro-batch takes max_files files at most."""
    raw = spark.readStream.schema("batch_id long, received_at timestamp, api_key string, body string").option("maxFilesPerTrigger", max_files).json(path)
    return parse_requests(raw)
