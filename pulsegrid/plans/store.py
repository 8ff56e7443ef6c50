"""The ingest path down to its tables at rest, all of which an epoch changes in one step.

Under one path lie series (by bucket of the natural key), points (by week), rejects (by reason), last_seen and limits,
and the log of commits that says which of their folders count (sources/log.py). An epoch writes all five and then
commits once, with the stream it belongs to and its number. So one that fails anywhere leaves nothing that is read, one
that runs again takes the place of its first run or, once others have built on it, changes nothing, and epochs of
another stream (a new checkpoint) come after those that are there, whatever their numbers. Limits and ids of series
go on from the latest commit, also where numbers of epochs are missing. One writer of epochs at a time: a second one is
told. compact, purge_points, retire_weeks and vacuum may run beside it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import limits as lim
from pulsegrid.operators.auth import entitled_requests, ingest_status, permits_used
from pulsegrid.operators.points import last_seen, loss_summary, touch_sources
from pulsegrid.operators.resolve import SERIES_KEY, assign_ids, series_seen
from pulsegrid.plans.ingest import ingested, resolved_points, slim
from pulsegrid.sources.log import State, commit, new_try, read_folders, read_state, written_parts
from pulsegrid.sources.scratch import written
from pulsegrid.sources.tables import add_points, compact_points, read_facts

#: Windows of the rate limit that are remembered behind the latest one: an hour of minutes. Older requests are refused.
KEEP_WINDOWS = 60
#: Folders that the series dimension is parted into by a hash of the natural key.
SERIES_BUCKETS = 64
#: Keys of series up to which a look-up asks the files' Bloom filters for each of them.
LOOK_UP = 256

REJECT, SEEN, USED = f"{lim.REJECT}, epoch long", "source_id int, last_seen_at timestamp, epoch long", "key_id int, win long, used long"
LOSS = "reason string, points long, first_ts timestamp, last_ts timestamp, series long, series_ids array<int>, epoch long"
STORED_SERIES = f"{lim.SERIES}, key_hash long, bucket int"


def series_hash(labels: str) -> Column:
    """A hash of the natural key of a series."""
    return F.xxhash64("tenant_id", "source_id", "name", labels)


def read_series(spark: SparkSession, path: str, state: State | None = None) -> DataFrame:
    """The series dimension."""
    state = read_state(spark, path) if state is None else state
    return read_folders(spark, path, state, "series", STORED_SERIES).drop("key_hash", "bucket")


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """batch_id, pos, reason, n_points and epoch; filters on reason prune folders."""
    return read_folders(spark, path, read_state(spark, path), "rejects", REJECT)


def read_losses(spark: SparkSession, path: str) -> DataFrame:
    """reason, points, first_ts, last_ts, series, series_ids (the least ones) and epoch of epochs whose points were given up."""
    return read_folders(spark, path, read_state(spark, path), "losses", LOSS)


def read_sources(sources: DataFrame, path: str) -> DataFrame:
    """sources with the last_seen_at that the latest epoch gave each."""
    spark = sources.sparkSession
    seen = read_folders(spark, path, read_state(spark, path), "last_seen", SEEN)
    return touch_sources(sources, seen.groupBy("source_id").agg(F.max_by("last_seen_at", "epoch").alias("last_seen_at")))


def known_series(spark: SparkSession, path: str, state: State, keys: DataFrame) -> DataFrame:
    """Of the dimension what may be among keys (key_hash, bucket; one row a series): only the buckets they fall in are read.

    Bucket numbers come to the driver, of which there are SERIES_BUCKETS at most. Up to LOOK_UP keys are asked for by
    value too, so that files' Bloom filters and statistics leave out row groups without them.
    """
    n, buckets = keys.agg(F.count(F.lit(1)), F.collect_set("bucket")).first()
    folders = [f for f in state.folders("series") if int(f.rsplit("bucket=", 1)[-1]) in set(buckets)]
    found = read_folders(spark, path, state, "series", STORED_SERIES, folders)
    if 0 < n <= LOOK_UP:
        wanted = F.lit(False)
        for row in keys.select("key_hash").distinct().collect():
            wanted = wanted | (F.col("key_hash") == row["key_hash"])
        found = found.where(wanted)
    return found.drop("key_hash", "bucket")


#: The stream of commits of append_series.
SERIES_STREAM = "series"


@dataclass
class Series:
    """known: the dimension as far as points touch it, new series among them; folders: what was written; last: the greatest id."""

    known: DataFrame
    folders: list[str]
    last: int


def add_series(points: DataFrame, path: str, state: State) -> Series:
    """Writes the series of points (with canonical) that the dimension lacks, with ids that go on from the last one, to folders that do not count yet."""
    spark, token = points.sparkSession, new_try()
    bucket = F.pmod(F.col("key_hash"), F.lit(SERIES_BUCKETS)).cast("int")
    seen = written(series_seen(points).withColumn("key_hash", series_hash("canonical")).withColumn("bucket", bucket), "seen")
    known = known_series(spark, path, state, seen.select("key_hash", "bucket"))
    fresh = seen.join(known.select("tenant_id", "source_id", "name", F.col("labels").alias("canonical")), SERIES_KEY, "left_anti")
    last = state.facts.get("last_series_id", 0)
    added = assign_ids(fresh, SERIES_KEY, last + 1).withColumnRenamed("canonical", "labels").select(*spark.createDataFrame([], STORED_SERIES).columns)
    dealt = added.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "key_hash")
    dealt.write.option("parquet.bloom.filter.enabled#key_hash", "true").partitionBy("bucket").parquet(f"{path}/series/{token}")
    folders = written_parts(spark, path, "series", token, "bucket")
    new = read_folders(spark, path, state, "series", STORED_SERIES, [f"series/{token}"] if folders else []).drop("key_hash", "bucket")
    return Series(known.unionByName(new), folders, new.agg(F.max("id")).first()[0] or last)


def append_series(points: DataFrame, path: str) -> DataFrame:
    """Adds the series of points (with canonical) that the dimension lacks, in one step; the dimension as far as points touch it."""
    spark = points.sparkSession
    state = read_state(spark, path)
    series = add_series(points, path, state)
    if series.folders:
        commit(spark, path, state, {"add": {"series": series.folders}, "facts": {"last_series_id": series.last}, "stream": SERIES_STREAM, "epoch": state.version + 1})
    return series.known


def ingest_epoch(requests: DataFrame, dims: dict[str, DataFrame], path: str, epoch: int, permit: int = lim.RATE_PERMIT, window_seconds: int = lim.RATE_WINDOW_SECONDS, keep_windows: int = KEEP_WINDOWS, stream: str | None = None, lost_as: str | None = None) -> int:
    """Takes requests through all stages, writes every table's part and commits them in one step; returns the number of points written.

    dims: api_keys, sources and weeks (week). Permits that earlier epochs used count, in windows up to keep_windows
    behind the latest. Points in weeks that do not exist, and refused requests, are rejects, each with its reason.

    epoch counts up within its stream; without one it is the stream that committed last. The last epoch of a stream may run again: it starts from where its first run
    started and takes its place. An earlier one, or one whose folders have been changed since, is left as it is.

    lost_as: a reason for which the points are given up. They are not written; a row of losses says how many there were,
    of what span and series, and each request has a reject of that reason. Sources are not seen by such an epoch.
    """
    spark = requests.sparkSession
    state = read_state(spark, path)
    stream = stream or max(state.streams.keys() - {SERIES_STREAM}, key=lambda name: state.streams[name]["version"], default="batch")
    last = state.streams.get(stream)
    if last and epoch <= last["epoch"]:
        newest = all(s["version"] <= last["version"] for s in state.streams.values())
        if epoch < last["epoch"] or not newest or not state.holds(last["add"]):
            return last["rows"] if epoch == last["epoch"] else 0
        old, limits, first_id = last["add"], last["keep"]["limits"], last["first_id"]
    else:
        old, limits, first_id = {}, state.folders("limits"), state.facts.get("last_series_id", 0)
    base = state.after(state.version, {"remove": old, "facts": {"last_series_id": first_id}})
    before = read_folders(spark, path, state, "limits", USED, limits)
    latest = before.agg(F.max("win")).first()[0]
    oldest = None if latest is None else latest - keep_windows
    number, token = state.version + 1, new_try()
    statuses = slim(ingest_status(requests, dims["api_keys"], permit, window_seconds, used=before, oldest=oldest)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        done = ingested(statuses, dims["sources"])
        done.points = written(done.points.drop("labels"), "points")
        series = add_series(done.points, path, base)
        covered, lost, _ = resolved_points(done, series.known, written(dims["weeks"].select("week").distinct(), "weeks"))
        refused, seen, lost_rows = done.rejects.unionByName(lost), done.accepted, []
        if lost_as is None:
            points, rows = add_points(covered, path)
        else:
            points, rows, lost_rows, seen = [], 0, [f"losses/{token}"], done.accepted.limit(0)
            gone = covered.withColumn("reason", F.lit(lost_as))
            loss_summary(gone, ["reason"]).withColumn("epoch", F.lit(number).cast("long")).write.parquet(f"{path}/losses/{token}")
            refused = refused.unionByName(gone.groupBy("batch_id", F.lit(None).cast("int").alias("pos"), "reason").agg(F.count(F.lit(1)).alias("n_points")))
        rejects = refused.withColumn("epoch", F.lit(number).cast("long"))
        rejects.write.partitionBy("reason").parquet(f"{path}/rejects/{token}")
        last_seen(seen).withColumn("epoch", F.lit(number).cast("long")).write.parquet(f"{path}/last_seen/{token}")
        entitled = entitled_requests(statuses.select("batch_id", "key_id", "received_at", "scope"))
        used = permits_used(entitled, window_seconds).unionByName(before.select("key_id", "win", "used"))
        used = written(used.groupBy(F.col("key_id").cast("int").alias("key_id"), "win").agg(F.sum("used").alias("used")), "used")
        newest = used.agg(F.max("win").alias("_newest"))
        # one row, the latest window
        used = used.crossJoin(F.broadcast(newest)).where(F.col("win") >= F.col("_newest") - keep_windows).drop("_newest")
        used.write.parquet(f"{path}/limits/{token}")
        add = {"series": series.folders, "points": points, "rejects": written_parts(spark, path, "rejects", token, "reason"), "last_seen": [f"last_seen/{token}"], "limits": [f"limits/{token}"], "losses": lost_rows}
        remove = {t: f for t, f in old.items() if f and t != "limits"} | {"limits": state.folders("limits")}
        record = {"stream": stream, "epoch": epoch, "rows": rows, "keep": {"limits": limits}, "first_id": first_id, "add": add, "remove": remove, "facts": {"last_series_id": series.last}}
        commit(spark, path, state, record)
        return rows
    finally:
        statuses.unpersist()


def compact(spark: SparkSession, path: str, most: int = 1) -> dict[str, int]:
    """Joins the folders of many epochs, of each table with more than most, and swaps them in; the number of folders that went, by table.

    A week's points and a bucket's series become one folder each; rejects become one for each reason; of last_seen the
    latest of each source stays. Limits are one folder anyway.
    """
    gone = {"points": 0, "series": 0, "rejects": 0, "last_seen": 0}
    before = len(read_state(spark, path).folders("points"))
    kept = compact_points(spark, path, most)
    gone["points"] = before - len(read_state(spark, path).folders("points")) if kept else 0
    for table, schema, column in (("series", STORED_SERIES, "bucket"), ("rejects", REJECT, "reason"), ("last_seen", SEEN, None)):
        state, by_part, token = read_state(spark, path), {}, new_try()
        for f in state.folders(table):
            by_part.setdefault(f.rsplit("/", 1)[-1] if column else "", []).append(f)
        old = [f for found in by_part.values() if len(found) > most for f in found]
        if not old:
            continue
        rows = read_folders(spark, path, state, table, schema, old)
        if column is None:
            rows.groupBy("source_id").agg(F.max_by("last_seen_at", "epoch").alias("last_seen_at"), F.max("epoch").alias("epoch")).write.parquet(f"{path}/{table}/{token}")
            new = [f"{table}/{token}"]
        else:
            order = ["bucket", "key_hash"] if table == "series" else ["reason", "epoch", "batch_id"]
            dealt = rows.hint("rebalance", F.col(column)).sortWithinPartitions(*order)
            dealt.write.option("parquet.bloom.filter.enabled#key_hash", "true").partitionBy(column).parquet(f"{path}/{table}/{token}")
            new = written_parts(spark, path, table, token, column)
        commit(spark, path, state, {"remove": {table: old}, "add": {table: new}})
        gone[table] = len(old) - len(new)
    return gone


def read_points_of(spark: SparkSession, path: str) -> DataFrame:
    """Points with their series' natural key: tenant_id, source_id, name, labels, series_id, ts, value, week."""
    series = read_series(spark, path).select(F.col("id").alias("series_id"), "tenant_id", "source_id", "name", "labels")
    return read_facts(spark, path).join(series, "series_id")
