"""Reading and writing files, and streams over more than one micro-batch."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import limits as lim
from pulsegrid.operators import resolve
from pulsegrid.plans import store
from pulsegrid.sources.log import Conflict, commit, read_state, vacuum
from pulsegrid.plans.ingest import slim
from pulsegrid.sources.tables import compact_points, load_dims, purge_points, read_facts, read_requests, read_spool, retire_weeks, write_points
from pulsegrid.streaming import jobs

ANCHOR = dt.datetime(2034, 2, 6, 12)


def test_points_are_written_by_week_and_counted(spark, tmp_path):
    rows = [(1, ANCHOR + dt.timedelta(seconds=i), i * 0.5) for i in range(500)] + [(2, ANCHOR + dt.timedelta(days=7), 1.0)]
    assert write_points(spark.createDataFrame(rows, lim.POINT), f"{tmp_path}/p") == 501
    assert write_points(spark.createDataFrame([], lim.POINT), f"{tmp_path}/p") == 0
    back = read_facts(spark, f"{tmp_path}/p")
    assert back.count() == 501 and {r.week for r in back.select("week").distinct().collect()} == {dt.datetime(2034, 2, 6), dt.datetime(2034, 2, 13)}
    pruned = back.where(F.col("week") >= F.lit(dt.datetime(2034, 2, 13)))
    assert pruned.count() == 1 and "PartitionFilters: [isnotnull" in pruned._jdf.queryExecution().executedPlan().toString()


def test_request_logs_and_spools(spark, tmp_path):
    body = json.dumps({"source": "h", "points": [{"name": "a", "unit": "u", "ts": "2034-02-06T12:00:00Z", "value": 1, "labels": {"k": "1", "k": "2"}}]})
    (tmp_path / "log.json").write_text("\n".join(json.dumps({"batch_id": i, "received_at": "2034-02-06T12:00:00Z", "api_key": "k", "body": b}) for i, b in enumerate([body, "no json", "{}"])))
    rows = read_requests(spark, str(tmp_path / "log.json")).orderBy("batch_id").collect()
    assert rows[0].source == "h" and rows[0].points[0].labels == {"k": "2"} and rows[1].points is None and rows[2].source is None
    (tmp_path / "spool/host1").mkdir(parents=True)
    (tmp_path / "spool/host1/20340206T1200000000000-000001-a.json").write_text(body)
    (tmp_path / "spool/host1/20340206T1200000000000-000002-a.json.tmp").write_text(body)
    assert [(r.host, r.file_name[23:29]) for r in read_spool(spark, str(tmp_path / "spool")).collect()] == [("host1", "000001")]


def test_dimensions(spark, tmp_path):
    for name, schema in {"tenants": lim.TENANT, "api_keys": lim.API_KEY, "sources": lim.SOURCE, "series": lim.SERIES}.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}")
    assert {n: d.count() for n, d in load_dims(spark, str(tmp_path)).items()} == {"tenants": 0, "api_keys": 0, "sources": 0, "series": 0}


def in_turns(spark, tmp_path, batches, build):
    """Runs a stream over one file per micro-batch."""
    for i, b in enumerate(batches):
        b.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    out = build(spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    run = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()


def test_limits_hold_across_batches(spark, tmp_path):
    rows = lambda ids: spark.createDataFrame([(i, 1, ANCHOR + dt.timedelta(seconds=i)) for i in ids], "batch_id long, key_id long, received_at timestamp")
    got = in_turns(spark, tmp_path, [rows([0, 1]), rows([2, 3]), rows([61])], lambda r: jobs.rate_limit_stream(r, 3, 60))
    assert {r.batch_id: r.allowed for r in got} == {0: True, 1: True, 2: True, 3: False, 61: True}


def test_late_requests_get_a_verdict(spark, tmp_path):
    rows = lambda xs: spark.createDataFrame([(i, 1, ANCHOR + dt.timedelta(seconds=s)) for i, s in xs], "batch_id long, key_id long, received_at timestamp")
    turns = [rows([(0, 0), (1, 1), (2, 2), (3, 61)]), rows([(4, 5), (5, 62)]), rows([(6, 3600)]), rows([(7, 63)])]
    got = in_turns(spark, tmp_path, turns, lambda r: jobs.rate_limit_stream(r, 3, 60, keep_windows=30))
    assert {r.batch_id: r.reason for r in got} == {0: None, 1: None, 2: None, 3: None, 4: "rate_limited", 5: None, 6: None, 7: "late"}
    assert all(r.allowed == (r.reason is None) for r in got)


def requests_at(spark, seconds, first=0):
    """One request of one point at each second, with the key "k" and the source "h"."""
    at = lambda s: ANCHOR + dt.timedelta(seconds=s)
    rows = [(first + i, at(s), "k", "h", [("a.b", "u", at(s).isoformat() + "Z", float(s), {"n": str(s % 2)})]) for i, s in enumerate(seconds)]
    return spark.createDataFrame(rows, lim.REQUEST)


def dims_of(spark):
    from pulsegrid.functions.scalars import key_hash

    keys = spark.createDataFrame([(1, 7, "k", 0)], "id int, tenant_id int, key string, scope int").select("id", "tenant_id", key_hash(F.col("key")).alias("key_hash"), "scope", F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("revoked_at"))
    sources = spark.createDataFrame([(3, 7, "h", 0, "{}", None)], lim.SOURCE)
    return {"api_keys": keys, "sources": sources, "weeks": spark.createDataFrame([(dt.datetime(2034, 2, 6),)], "week timestamp")}


def test_ingest_over_micro_batches(spark, tmp_path):
    path = str(tmp_path / "out")
    turns = [requests_at(spark, [0, 1, 2]), requests_at(spark, [3, 4, 61], 10), requests_at(spark, [5, 62, 7 * 86400 + 1], 20)]
    for i, turn in enumerate(turns):
        turn.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(turn.schema).parquet(f"{tmp_path}/in")
        jobs.ingest_stream(stream, lambda: dims_of(spark), path, f"{tmp_path}/state", 3, 60, {"availableNow": True}, keep_windows=20_000).awaitTermination()
    seen = lambda: sorted((r.ts.minute, r.ts.second, r.value, r.labels) for r in store.read_points_of(spark, path).collect())
    want = [(0, s, float(s), '{"n":"%d"}' % (s % 2)) for s in (0, 1, 2)] + [(1, s - 60, float(s), '{"n":"%d"}' % (s % 2)) for s in (61, 62)]
    rejects = lambda: sorted((r.reason, r.batch_id) for r in store.read_rejects(spark, path).collect())
    lost = [("no_partition", 22), ("rate_limited", 10), ("rate_limited", 11), ("rate_limited", 20)]
    assert seen() == want and rejects() == lost
    assert store.read_series(spark, path).count() == 2
    assert [r.last_seen_at for r in store.read_sources(dims_of(spark)["sources"], path).collect()] == [ANCHOR + dt.timedelta(days=7, seconds=1)]
    # an epoch that runs again changes nothing
    store.ingest_epoch(turns[1], dims_of(spark), path, 1, 3, 60, 20_000)
    assert seen() == want and rejects() == lost and sorted(r.id for r in store.read_series(spark, path).collect()) == [1, 2]


def test_an_epoch_reads_its_requests_twice(spark, tmp_path):
    read, found = spark.sparkContext.accumulator(0), requests_at(spark, list(range(40)))

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    store.ingest_epoch(found.mapInArrow(counted, found.schema), dims_of(spark), str(tmp_path), 0, 3, 60)
    assert read.value == 80
    # refused requests keep the number of their points alone
    rows = found.selectExpr("*", "1 AS key_id", "1 AS tenant_id", "'ingest' AS scope", "if(batch_id = 0, 202, 429) AS status")
    kept = slim(rows).orderBy("batch_id").collect()
    assert {r.n_points for r in kept} == {1} and [r.batch_id for r in kept if r.points] == [0]


def test_requests_older_than_the_kept_windows_are_refused(spark, tmp_path):
    path = str(tmp_path)
    assert store.ingest_epoch(requests_at(spark, [7200]), dims_of(spark), path, 0, 3, 60, 60) == 1
    assert store.ingest_epoch(requests_at(spark, [0, 7201], 10), dims_of(spark), path, 1, 3, 60, 60) == 1
    assert [(r.reason, r.batch_id) for r in store.read_rejects(spark, path).collect()] == [("rate_limited", 10)]


def test_anchored_walk_over_small_batches(spark):
    import random

    from pulsegrid.operators.auth import rate_limit

    rng = random.Random(3)
    rows = [(i, rng.choice([1, 2, None]), ANCHOR + dt.timedelta(seconds=rng.randrange(4000))) for i in range(600)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.batch_id: r.allowed for r in rate_limit(spark.createDataFrame(rows, "batch_id long, key_id long, received_at timestamp"), 3, 60, "anchored").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {i: True for i, k, _ in rows if k is None}
    for key in (1, 2):
        end, count = None, 0
        for at, i in sorted((at, i) for i, k, at in rows if k == key):
            if end is None or at >= end:
                end, count = at + dt.timedelta(seconds=60), 0
            count += 1
            want[i] = count <= 3
    assert got == want


def test_purge_rewrites_only_the_weeks_concerned(spark, tmp_path):
    rows = [(1, ANCHOR, 1.0), (2, ANCHOR, 2.0), (2, ANCHOR + dt.timedelta(days=7), 3.0), (1, ANCHOR + dt.timedelta(days=14), 4.0)]
    write_points(spark.createDataFrame(rows, lim.POINT), f"{tmp_path}/p")
    assert purge_points(spark, f"{tmp_path}/p", spark.createDataFrame([(1,)], "id int")) == ["2034-02-06", "2034-02-20"]
    assert sorted((r.series_id, r.value) for r in read_facts(spark, f"{tmp_path}/p").collect()) == [(2, 2.0), (2, 3.0)]
    assert purge_points(spark, f"{tmp_path}/p", spark.createDataFrame([(1,)], "id int")) == []


def test_cpu_state_goes_from_batch_to_batch(spark, tmp_path):
    line = lambda idle, total: f"cpu {total - idle} 0 0 {idle} 0 0"
    rows = lambda xs: spark.createDataFrame([("h", ANCHOR + dt.timedelta(seconds=s), c) for s, c in xs], "host string, ts timestamp, content string")
    got = in_turns(spark, tmp_path, [rows([(0, line(100, 200))]), rows([(10, "cpu broken")]), rows([(20, line(150, 300)), (30, line(150, 300))])], jobs.cpu_usage_stream)
    assert sorted((r.ts.second, r.usage) for r in got) == [(20, 50.0), (30, None)]


def test_rollup_stream_and_losses(spark, tmp_path):
    rows = lambda xs: spark.createDataFrame([(1, ANCHOR + dt.timedelta(seconds=s), v) for s, v in xs], lim.POINT)
    got = in_turns(spark, tmp_path, [rows([(0, 1.0), (30, 3.0)]), rows([(3600, 9.0)]), rows([(7200, 1.0)])], lambda p: jobs.rollup_1m_stream(p, "1 minute"))
    assert ("2034-02-06 12:00:00", 2, 4.0, 3.0) in {(str(r.bucket), r.n, r.total, r.last) for r in got}
    assert jobs.losses_stream(spark.createDataFrame([(1, None, "x", 3)], lim.REJECT)).count() == 1


# -- tables at rest ----------------------------------------------------------------------------------------------------


def point_rows(spark, path):
    return sorted(r.value for r in store.read_points_of(spark, path).collect())


def reject_rows(spark, path):
    return sorted((r.reason, r.batch_id) for r in store.read_rejects(spark, path).collect())


def without_sources(spark):
    return dims_of(spark) | {"sources": spark.createDataFrame([], lim.SOURCE)}


def test_retry_leaves_one_outcome(spark, tmp_path):
    """The first run finds no source, the second does: the point is there and its reject is not."""
    path = str(tmp_path)
    assert store.ingest_epoch(requests_at(spark, [1]), without_sources(spark), path, 0, 3, 60, stream="a") == 0
    assert reject_rows(spark, path) == [("unknown_source", 0)] and point_rows(spark, path) == []
    assert store.ingest_epoch(requests_at(spark, [1]), dims_of(spark), path, 0, 3, 60, stream="a") == 1
    assert reject_rows(spark, path) == [] and point_rows(spark, path) == [1.0]
    # and the other way round; a week, a series and permits that the first run had are gone too
    assert store.ingest_epoch(requests_at(spark, [2, 3, 4, 5]), dims_of(spark), path, 1, 3, 60, stream="a") == 2
    assert store.ingest_epoch(requests_at(spark, [2, 62]), without_sources(spark), path, 1, 3, 60, stream="a") == 0
    assert point_rows(spark, path) == [1.0] and reject_rows(spark, path) == [("unknown_source", 0), ("unknown_source", 1)]
    assert [r.id for r in store.read_series(spark, path).collect()] == [1]
    assert store.ingest_epoch(requests_at(spark, [3, 4], 10), dims_of(spark), path, 2, 3, 60, stream="a") == 1


def test_restart_and_gap(spark, tmp_path):
    path = str(tmp_path)
    for epoch in (0, 1):
        store.ingest_epoch(requests_at(spark, [epoch]), dims_of(spark), path, epoch, 3, 60, stream="a")
    # another stream begins at 0 again: it takes nothing away, and limits go on
    for epoch in (0, 1):
        store.ingest_epoch(requests_at(spark, [10 + epoch]), dims_of(spark), path, epoch, 3, 60, stream="b")
    assert point_rows(spark, path) == [0.0, 1.0, 10.0] and reject_rows(spark, path) == [("rate_limited", 0)]
    # numbers may be missing: the latest limits count
    assert store.ingest_epoch(requests_at(spark, [20]), dims_of(spark), path, 7, 3, 60, stream="b") == 0
    # the first stream's last epoch is no longer the latest: it stays as it is
    assert store.ingest_epoch(requests_at(spark, [30]), dims_of(spark), path, 1, 3, 60, stream="a") == 1
    assert point_rows(spark, path) == [0.0, 1.0, 10.0]


@pytest.mark.parametrize("failing", range(6))
def test_failure_after_each_write(spark, tmp_path, monkeypatch, failing):
    """A try that fails after any of its writes, or on committing, leaves nothing that is read; the next one gives what one try would."""
    path, turns = str(tmp_path), [requests_at(spark, [0, 1]), requests_at(spark, [2, 3, 61], 10)]
    store.ingest_epoch(turns[0], dims_of(spark), path, 0, 3, 60, stream="a")
    before = point_rows(spark, path), reject_rows(spark, path), store.read_series(spark, path).count()
    steps = ["add_series", "add_points", "written_parts", "last_seen", "permits_used", "commit"]
    name, real = steps[failing], getattr(store, steps[failing])

    def broken(*args, **kwargs):
        if name != "commit":
            real(*args, **kwargs)
        raise RuntimeError("lost")

    monkeypatch.setattr(store, name, broken)
    with pytest.raises(RuntimeError):
        store.ingest_epoch(turns[1], dims_of(spark), path, 1, 3, 60, stream="a")
    monkeypatch.setattr(store, name, real)
    assert (point_rows(spark, path), reject_rows(spark, path), store.read_series(spark, path).count()) == before
    store.ingest_epoch(turns[1], dims_of(spark), path, 1, 3, 60, stream="a")
    assert point_rows(spark, path) == [0.0, 1.0, 2.0, 61.0] and reject_rows(spark, path) == [("rate_limited", 11)]
    assert sorted(r.id for r in store.read_series(spark, path).collect()) == [1, 2]


def test_two_writers_of_epochs(spark, tmp_path):
    path = str(tmp_path)
    state = read_state(spark, path)
    store.ingest_epoch(requests_at(spark, [0]), dims_of(spark), path, 0, 3, 60, stream="a")
    with pytest.raises(Conflict):
        commit(spark, path, state, {"stream": "b", "epoch": 0, "add": {}})
    # what takes nothing away that is gone, and is no epoch, goes in
    assert commit(spark, path, state, {"add": {"other": ["other/try=x"]}}).version == 1
    with pytest.raises(Conflict):
        commit(spark, path, state, {"remove": {"points": ["points/try=none/week=2034-02-06"]}})


def test_states_are_written_now_and_then(spark, tmp_path):
    path, state = str(tmp_path), read_state(spark, str(tmp_path))
    for i in range(70):
        state = commit(spark, path, state, {"add": {"t": [f"t/try={i}"]}, "remove": {"t": [f"t/try={i - 1}"] if i % 2 else []}, "facts": {"n": i}})
    assert read_state(spark, path) == state and state.facts == {"n": 69} and len(state.folders("t")) == 35
    assert read_state(spark, path, 10).folders("t") == [f"t/try={i}" for i in (1, 3, 5, 7, 9, 10)]
    vacuum(spark, path, dt.datetime(2100, 1, 1))
    assert read_state(spark, path) == state and len([n for n in (tmp_path / "_log").iterdir() if n.suffix == ".json" and n.name[0] != "."]) < 12


def test_purge_compaction_and_retention_between_epochs(spark, tmp_path, monkeypatch):
    path, week = str(tmp_path), 7 * 86400
    dims = dims_of(spark)
    dims["weeks"] = spark.createDataFrame([(dt.datetime(2034, 2, 6),), (dt.datetime(2034, 2, 13),)], "week timestamp")
    many = lambda epoch, seconds: store.ingest_epoch(requests_at(spark, seconds, 100 * epoch), dims, path, epoch, 100, 60, 20_000, stream="a")
    many(0, [0, 1, 2, week])
    odd = store.read_series(spark, path).where("labels like '%1%'").select("id")
    assert purge_points(spark, path, odd) == ["2034-02-06"]
    # the next epochs go beside what the purge has written
    many(1, [3, 4, week + 1])
    many(2, [6, week + 2])
    assert point_rows(spark, path) == [0.0, 2.0, 3.0, 4.0, 6.0, *(float(week + i) for i in range(3))]
    monkeypatch.setattr("pulsegrid.sources.tables.commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        compact_points(spark, path)
    with pytest.raises(RuntimeError):
        purge_points(spark, path, odd)
    monkeypatch.undo()
    rows, rejects, seen = point_rows(spark, path), reject_rows(spark, path), [r.last_seen_at for r in store.read_sources(dims["sources"], path).collect()]
    gone = store.compact(spark, path)
    assert gone["points"] == 4 and gone["last_seen"] == 2 and sum(gone.values()) == 6
    assert len(read_state(spark, path).folders("points")) == 2 and store.compact(spark, path) == dict.fromkeys(gone, 0)
    assert (point_rows(spark, path), reject_rows(spark, path)) == (rows, rejects) and [r.last_seen_at for r in store.read_sources(dims["sources"], path).collect()] == seen
    # an epoch whose folders have been joined with others is not run again
    assert many(2, [6, week + 2, 7]) == 2 and point_rows(spark, path) == rows
    files = len(list((tmp_path / "points").rglob("*.parquet")))
    vacuum(spark, path, dt.datetime(2000, 1, 1))
    assert len(list((tmp_path / "points").rglob("*.parquet"))) == files
    vacuum(spark, path, dt.datetime(2100, 1, 1))
    assert len(list((tmp_path / "points").rglob("*.parquet"))) < files and point_rows(spark, path) == rows and reject_rows(spark, path) == rejects
    state = read_state(spark, path)
    commit(spark, path, state, {"add": {"points": ["points/try=x/week=rogue"]}})
    judged = retire_weeks(spark, path, dt.datetime(2034, 2, 20), 7)
    assert sorted(map(tuple, judged.collect())) == [("2034-02-06", "drop"), ("2034-02-13", "keep"), ("rogue", "unknown")]
    state = read_state(spark, path)
    assert [f.rsplit("=")[-1] for f in state.folders("points")] == ["2034-02-13", "rogue"]
    commit(spark, path, state, {"remove": {"points": ["points/try=x/week=rogue"]}})
    many(3, [8])
    assert point_rows(spark, path) == [8.0, *(float(week + i) for i in range(3))]


def test_series_are_looked_up_in_their_buckets_alone(spark, tmp_path):
    from pulsegrid.operators.resolve import with_canonical

    path, schema = str(tmp_path), "tenant_id int, source_id int, name string, unit string, labels map<string,string>, received_at timestamp, batch_id long, pos int"
    points = lambda ids: with_canonical(spark.createDataFrame([(1, i % 50, f"m.{i}", "u", {"k": str(i)}, ANCHOR, i, 0) for i in ids], schema))
    store.append_series(points(range(600)), path)
    all_folders = read_state(spark, path).folders("series")
    assert len(all_folders) == store.SERIES_BUCKETS
    known = store.append_series(points([3, 700]), path)
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.name for r in known.collect()) == ["m.3", "m.700"] and "PushedFilters: [Or(EqualTo(key_hash" in plan
    scanned = {f.rsplit("/", 1)[0] for f in known.inputFiles()}
    assert len(scanned) <= 3 < len(all_folders)
    ids = {r.name: r.id for r in store.read_series(spark, path).collect()}
    assert sorted(ids.values()) == list(range(1, 602)) and ids["m.700"] == 601
    # the same ids as the batch form gives
    batch = {r.name: r.id for r in resolve.upsert_series(points(range(600)), spark.createDataFrame([], lim.SERIES)).collect()}
    assert {n: i for n, i in ids.items() if n != "m.700"} == batch
    assert store.compact(spark, path)["series"] > 0 and {r.name: r.id for r in store.read_series(spark, path).collect()} == ids


def test_a_new_checkpoint_adds_epochs(spark, tmp_path):
    path = str(tmp_path / "out")
    for i, turn in enumerate([requests_at(spark, [0, 1]), requests_at(spark, [2, 3], 10)]):
        turn.coalesce(1).write.parquet(f"{tmp_path}/in{i}")
        jobs.ingest_stream(spark.readStream.schema(turn.schema).parquet(f"{tmp_path}/in{i}"), lambda: dims_of(spark), path, f"{tmp_path}/state{i}", 100, 60, {"availableNow": True}).awaitTermination()
    assert point_rows(spark, path) == [0.0, 1.0, 2.0, 3.0] and len(read_state(spark, path).streams) == 2


def test_a_micro_batch_that_cannot_be_written_is_passed_over(spark, tmp_path, monkeypatch):
    path, turns = str(tmp_path / "out"), [requests_at(spark, [0]), requests_at(spark, [1, 2, 7 * 86400], 10), requests_at(spark, [3], 20)]
    real, calls = store.add_points, []

    def failing(points, where):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("disk")
        return real(points, where)

    monkeypatch.setattr(store, "add_points", failing)
    for turn in turns:
        turn.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(turn.schema).parquet(f"{tmp_path}/in")
        jobs.ingest_stream(stream, lambda: dims_of(spark), path, f"{tmp_path}/state", 100, 60, {"availableNow": True}, 20_000, pass_over=True).awaitTermination()
    assert point_rows(spark, path) == [0.0, 3.0] and len(calls) == 3
    (loss,) = store.read_losses(spark, path).collect()
    assert (loss.reason, loss.points, loss.first_ts, loss.last_ts, loss.series, loss.series_ids) == ("flush_failure", 2, ANCHOR + dt.timedelta(seconds=1), ANCHOR + dt.timedelta(seconds=2), 2, [1, 2])
    assert reject_rows(spark, path) == [("flush_failure", 10), ("flush_failure", 11), ("no_partition", 12)]
    assert [r.last_seen_at for r in store.read_sources(dims_of(spark)["sources"], path).collect()] == [ANCHOR + dt.timedelta(seconds=3)]


def test_only_touched_minutes_are_rolled_up_again(spark, tmp_path):
    from pulsegrid.operators.rollup import rollup_1h, rollup_1m
    from pulsegrid.plans import rollups

    path = str(tmp_path)
    points = lambda xs: spark.createDataFrame([(s, ANCHOR + dt.timedelta(seconds=t), v) for s, t, v in xs], lim.POINT)
    turns = [[(1, 0, 1.0), (1, 30, 3.0), (2, 0, 5.0), (2, 4000, 7.0)], [(1, 10, 4.0), (1, 3600, 9.0)], [(2, 59, 6.0), (3, 7 * 86400, 1.0)]]
    assert [rollups.roll_in(points(t), path, "a", i) for i, t in enumerate(turns)] == [3, 2, 2]
    assert rollups.roll_in(points(turns[2]), path, "a", 2) == 0 and rollups.refresh_rollups(spark, path) == 0
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    whole = rollup_1m(points(sum(turns, [])))
    assert rows(rollups.stored_rollup(spark, path, "minutes")) == rows(whole)
    assert rows(rollups.stored_rollup(spark, path, "hours")) == rows(rollup_1h(whole).drop("mean"))
    assert rollups.compact_rollups(spark, path) > 0 and rows(rollups.stored_rollup(spark, path, "minutes")) == rows(whole)
    compact_points(spark, path)
    assert rollups.refresh_rollups(spark, path) == 0
    purge_points(spark, path, spark.createDataFrame([(2,)], "id int"))
    left = rollup_1m(points([p for t in turns for p in t if p[0] != 2]))
    assert rollups.refresh_rollups(spark, path) == 0 and rows(rollups.stored_rollup(spark, path, "minutes")) == rows(left)
    assert rows(rollups.stored_rollup(spark, path, "hours")) == rows(rollup_1h(left).drop("mean"))


def test_a_refresh_reads_each_folder_of_points_once(spark, tmp_path, monkeypatch):
    from pulsegrid.plans import rollups

    read, facts = [], rollups.read_facts
    monkeypatch.setattr(rollups, "read_facts", lambda s, path, folders: read.extend(folders) or facts(s, path, folders))
    made = []
    for turn in ([(1, 0, 1.0), (1, 90, 2.0)], [(1, 30, 5.0), (2, 7200, 3.0)]):
        write_points(spark.createDataFrame([(k, ANCHOR + dt.timedelta(seconds=x), v) for k, x, v in turn], lim.POINT), f"{tmp_path}/p")
        read.clear()
        made.append((rollups.refresh_rollups(spark, f"{tmp_path}/p"), len(read), len(set(read))))
    assert made == [(2, 1, 1), (2, 2, 2)]
    minutes = rollups.stored_rollup(spark, f"{tmp_path}/p", "minutes").select("series_id", "n", "total", "last").collect()
    hours = rollups.stored_rollup(spark, f"{tmp_path}/p", "hours").select("series_id", "n", "total", "last").collect()
    assert sorted(map(tuple, minutes)) == [(1, 1, 2.0, 2.0), (1, 2, 6.0, 5.0), (2, 1, 3.0, 3.0)] and sorted(map(tuple, hours)) == [(1, 3, 8.0, 2.0), (2, 1, 3.0, 3.0)]


# -- spools as a stream --------------------------------------------------------------------------------------------------


def spool_file(folder, host, n, points=1):
    name = f"20340206T1200{n:02d}0000000-{n:06d}-a.json"
    (folder / host).mkdir(parents=True, exist_ok=True)
    (folder / host / name).write_text(json.dumps({"source": host, "points": [{"name": "a.b", "unit": "u", "ts": "2034-02-06T12:00:00Z", "value": n}] * points}))
    return name


def test_spool_offsets(tmp_path):
    from pulsegrid.sources.spool import SpoolReader

    a = [spool_file(tmp_path, "a", i, 3) for i in (1, 2, 4)]
    b = [spool_file(tmp_path, "b", i, 2) for i in (3, 5)]
    (tmp_path / "b" / "x.json.tmp").write_text("{}")
    reader = SpoolReader(f"file://{tmp_path}", 100)
    first = reader.latestOffset()
    assert first == {"a": a[0], "b": b[0]} and [(p.host, p.name) for p in reader.partitions({}, first)] == [("a", a[0]), ("b", b[0])]
    assert [next(reader.read(p))[:2] for p in reader.partitions({}, first)] == [("a", a[0]), ("b", b[0])]
    second = reader.latestOffset()
    assert second == {"a": a[1], "b": b[1]} and reader.latestOffset() == {"a": a[2], "b": b[1]} == reader.latestOffset()
    # nothing goes before it is processed; a new reader finds what is left
    assert len(list(tmp_path.rglob("*.json"))) == 5
    reader.commit(first)
    assert sorted(f.name for f in tmp_path.rglob("*.json")) == sorted(a[1:] + b[1:]) and (tmp_path / "b" / "x.json.tmp").exists()
    again = SpoolReader(f"file://{tmp_path}", 100)
    assert [(p.host, p.name) for p in again.partitions(first, second)] == [("a", a[1]), ("b", b[1])] and again.latestOffset() == {"a": a[2], "b": b[1]}
    # a trigger ends with the file that reaches the most points, the oldest first
    few = SpoolReader(f"file://{tmp_path}", 3)
    assert [few.latestOffset() for _ in range(3)] == [{"a": a[1]}, {"a": a[2]}, {"a": a[2], "b": b[1]}]
    assert SpoolReader(f"file://{tmp_path}/none", 3).latestOffset() == {}


def test_spool_tasks_read_many_files(tmp_path, monkeypatch):
    from pulsegrid.sources import spool

    files = sorted((f"h{i:03d}", spool_file(tmp_path, f"h{i:03d}", i % 50)) for i in range(300))
    size = (tmp_path / files[0][0] / files[0][1]).stat().st_size
    reads = []
    monkeypatch.setattr(spool, "points_in", lambda payload: reads.append(payload) or 1)
    reader = spool.SpoolReader(f"file://{tmp_path}", 10**9)
    end = reader.latestOffset()
    assert end == dict(files) and not reads
    parts = reader.partitions({}, end)
    assert len(parts) == 60 and sorted(row[:2] for p in parts for row in reader.read(p)) == files
    # a new reader knows no sizes and plans the same; bytes limit a task too, files already taken are left out
    again = spool.SpoolReader(f"file://{tmp_path}", 10**9)
    assert [(p.host, p.name, p.more) for p in again.partitions({}, end)] == [(p.host, p.name, p.more) for p in parts]
    monkeypatch.setattr(spool, "TASK_BYTES", 2 * size + 10)
    assert max(1 + len(p.more) for p in again.partitions({}, end)) == 2
    assert sorted(row[:2] for p in again.partitions(dict(files[:200]), end) for row in again.read(p)) == files[200:]
    # a limit that sizes do not rule out is counted in points
    few = spool.SpoolReader(f"file://{tmp_path}", 120)
    assert len(few.latestOffset()) == 120 == len(reads)
    reader.commit(dict(files[:299]))
    assert [f.name for f in tmp_path.rglob("*.json")] == [files[299][1]]


def test_spool_stream_goes_on_after_a_failure(spark, tmp_path):
    from pulsegrid.operators.spool import spool_requests
    from pulsegrid.sources.spool import spool_stream

    names, seen, fail = [spool_file(tmp_path / "in", h, i) for i in range(3) for h in ("a", "b")], [], [True]

    def take(batch, epoch):
        rows = [(r.host, r.file_name, r.points[0].value) for r in batch.collect()]
        if epoch == 1 and fail[0]:
            fail[0] = False
            raise RuntimeError("lost")
        seen.extend(rows)

    for _ in range(2):
        run = spool_requests(spool_stream(spark, str(tmp_path / "in"), 2)).writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "state")).start()
        try:
            run.processAllAvailable()
        except Exception:
            assert len(seen) == 2
        finally:
            run.stop()
    assert len(seen) == 6 == len(set(seen)) and sorted(n for _, n, _ in seen) == sorted(names)
