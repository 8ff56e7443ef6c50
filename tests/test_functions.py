"""Functions and operators on small tables with known answers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import limits as lim
from pulsegrid.functions import scalars as s
from pulsegrid.operators import auth, host, integrity, points, readback, resolve, retention, spool, validate

UTC = dt.timezone.utc
NOW = dt.datetime(2034, 2, 6, 12, 0, 0)


def one(spark, column, **values):
    types = {str: "string", int: "long", float: "double", dict: "map<string,string>"}
    schema = ", ".join(f"{k} {types.get(type(v), 'string')}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "labels, want",
    [
        (None, "{}"), ({}, "{}"), ({"region": "nyc", "disk": "sda"}, '{"disk":"sda","region":"nyc"}'), ({"msg": 'say "hi"'}, '{"msg":"say \\"hi\\""}'),
        ({"path": "a\\b"}, '{"path":"a\\\\b"}'), ({"k": 'a\\"b'}, '{"k":"a\\\\\\"b"}'),
    ],
)
def test_canonical_labels(spark, labels, want):
    df = spark.createDataFrame([(labels,)], "l map<string,string>")
    assert df.select(s.canonical_labels(F.col("l"))).first()[0] == want


def test_label_text_cannot_imitate_other_labels(spark):
    df = spark.createDataFrame([({"x": "a", "y": "b"},), ({'x":"a","y': "b"},)], "l map<string,string>")
    assert df.select(s.canonical_labels(F.col("l")).alias("c")).distinct().count() == 2


@pytest.mark.parametrize(
    "name, ok",
    [(n, True) for n in ("cpu.usage", "http.latency", "disk.free_bytes", "a", "a" * 128)] + [(n, False) for n in (None, "", "   ", "CPU.Usage", "cpu usage", "cpu..usage", ".cpu", "cpu.", "cpu;drop", "a" * 129, "cpu\n")],
)
def test_metric_names(spark, name, ok):
    assert spark.createDataFrame([(name,)], "n string").select(s.name_ok(F.col("n"))).first()[0] is ok


@pytest.mark.parametrize("text, ok", [("a", True), (None, False), ("", False), (" \t", False), ("　", False), ("x" * 32, True), ("x" * 33, False), ("\U0001f600" * 16, True), ("\U0001f600" * 17, False)])
def test_filled(spark, text, ok):
    assert spark.createDataFrame([(text,)], "n string").select(s.filled(F.col("n"), 32)).first()[0] is ok


def test_scope_table(spark):
    yes = {("control", "read"), ("control", "control"), ("read", "read"), ("ingest", "ingest")}
    no = {("read", "control"), ("ingest", "read"), ("read", "ingest"), ("control", "ingest"), ("ingest", "control"), ("", "read"), ("Control", "read"), ("admin", "read"), (None, "read")}
    rows = spark.createDataFrame(sorted(yes | no, key=str), "g string, r string").select("g", "r", s.scope_satisfies(F.col("g"), F.col("r")).alias("ok")).collect()
    assert {(r.g, r.r) for r in rows if r.ok} == yes


def test_outcomes_and_names(spark):
    codes = [202, 200, 408, 429, 500, 502, 503, 504, 599, 400, 401, 403, 404, 405, 413, 415]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in codes], "c int").select(s.classify_outcome(F.col("c"))).collect()]
    assert got == ["accepted"] + ["retry"] * 8 + ["rejected"] * 7
    df = spark.createDataFrame([("HttpProbe", "READ"), ("x", None)], "k string, s string")
    assert [tuple(r) for r in df.select(s.parse_kind(F.col("k")), s.parse_scope(F.col("s"))).collect()] == [(1, 1), (None, None)]


def test_times(spark):
    ts = [dt.datetime(2034, 2, 6, 12), dt.datetime(2040, 2, 5, 23, 59)]
    df = spark.createDataFrame([(t,) for t in ts], "t timestamp_ntz").select(F.col("t").cast("timestamp").alias("t"))
    week = s.week_start(F.col("t"))
    got = df.select(s.partition_name("metric_points", week).alias("n"), s.week_bounds(week).alias("b")).collect()
    assert [r.n for r in got] == ["metric_points_20340206", "metric_points_20400130"]
    assert got[0].b.lower == "2034-02-06 00:00:00+00:00" and got[0].b.upper == "2034-02-13 00:00:00+00:00"
    assert one(spark, s.to_utc(F.col("x")).cast("string"), x="2034-02-06T14:00:01+02:00") == "2034-02-06 12:00:01"
    name = one(spark, s.spool_name(F.to_timestamp(F.col("x")), F.lit(7), F.lit("ab")), x="2031-01-01 00:00:10.5")
    assert name == "20310101T0000105000000-000007-ab.json"
    assert one(spark, s.spool_parked_at(F.col("x")).cast("string"), x=name) == "2031-01-01 00:00:10.5"
    for bad in ("x-1.json", "20310101T000010500000-000007-ab.json", "99999999T9999999999999-1-a.json"):
        assert one(spark, s.spool_parked_at(F.col("x")).cast("string"), x=bad) == "1970-01-01 00:00:00"


@pytest.mark.parametrize("total, rest, want", [(1000.0, 5000.0, 0.0), (0.0, 5.0, 0.0), (200.0, 50.0, 75.0), (-1.0, 0.0, 0.0), (10.0, -10.0, 100.0)])
def test_used_percent(spark, total, rest, want):
    assert one(spark, s.used_percent(F.col("a"), F.col("b")), a=total, b=rest) == want


def request(spark, points, source="host", received="2034-02-06 12:00:00"):
    rows = [(1, received, "k", source, points)]
    df = spark.createDataFrame(rows, "batch_id long, received_at string, api_key string, source string, points array<struct<name:string,unit:string,ts:string,value:double,labels:map<string,string>>>")
    return df.withColumn("received_at", F.to_timestamp("received_at"))


def point(name="cpu.usage", unit="percent", ts="2034-02-06T12:00:00Z", value=1.0, labels=None):
    return (name, unit, ts, value, labels)


LONG = {chr(97 + i): "v" * 31 for i in range(8)}


@pytest.mark.parametrize(
    "bad, reasons",
    [
        (point(), []), (point(name="CPU Usage"), ["name"]), (point(unit="u" * 33), ["unit"]), (point(unit="u" * 32), []), (point(unit=" "), ["unit"]),
        (point(value=float("nan")), ["value"]), (point(value=float("-inf")), ["value"]), (point(value=None), ["value"]),
        (point(ts="2034-02-06T12:05:00Z"), []), (point(ts="2034-02-06T12:05:00.000001Z"), ["ts_future"]), (point(ts="2034-01-30T12:00:00Z"), []), (point(ts="2034-01-30T11:59:59.999999Z"), ["ts_old"]),
        (point(ts="never"), ["ts"]), (point(ts="2034-02-06T14:00:00+02:00"), []),
        (point(labels={"k" * 65: "v"}), ["label_length"]), (point(labels={"k": "v" * 129}), ["label_length"]), (point(labels={"k" * 64: "v" * 128}), []),
        (point(labels=LONG), []), (point(labels={k: "v" * 39 for k in LONG}), ["label_total"]), (point(labels={str(i): "v" for i in range(9)}), ["label_count"]),
        (point(labels={"k": None}), ["label_length"]), (point(labels={"k": "a\nb"}), ["labels_unstorable"]), (point(name=None, unit=None, value=None), ["name", "unit", "value"]),
    ],
)
def test_point_rules(spark, bad, reasons):
    assert validate.with_reasons(request(spark, [bad])).first().point_reasons == [reasons]


def test_one_bad_point_rejects_all_three(spark):
    good, rejects = validate.validate_batches(request(spark, [point(), point(name="X"), point()]))
    assert good.count() == 0 and [(r.reason, r.n_points) for r in rejects.collect()] == [("name", 3)]
    errors = validate.validation_errors(request(spark, [point(), point(name="X"), point()])).collect()
    assert [(e.pos, e.reason, e.message) for e in errors] == [(1, "name", lim.MESSAGES["name"])]


@pytest.mark.parametrize("n, source, reasons", [(0, "h", ["batch_empty"]), (1, "h", []), (1000, "h", []), (1001, "h", ["batch_too_large"]), (None, "h", ["batch_empty"]), (1, "s" * 200, []), (1, "s" * 201, ["source"]), (1, None, ["source"])])
def test_batch_rules(spark, n, source, reasons):
    assert validate.with_reasons(request(spark, None if n is None else [point()] * n, source)).first().batch_reasons == reasons


def keyed(spark):
    rows = [(1, 1, "key-a", 0, None), (2, 1, "key-r", 1, None), (3, 2, "key-old", 0, "2034-02-06 11:59:59"), (4, 2, "key-b", 0, "2034-02-06 12:00:01")]
    df = spark.createDataFrame(rows, "id int, tenant_id int, key string, scope int, revoked_at string")
    return df.select("id", "tenant_id", s.key_hash(F.col("key")).alias("key_hash"), F.lit("l").alias("label"), "scope", F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("last_used_at"), F.to_timestamp("revoked_at").alias("revoked_at"))


def test_statuses_in_order(spark):
    base = request(spark, [point()])
    tries = [(1, None), (2, "key-r"), (3, "key-a"), (4, "key-a"), (5, "key-old"), (6, "key-b"), (7, "nobody")]
    rows = spark.createDataFrame(tries, "b long, k string")
    df = base.crossJoin(rows).select(F.col("b").alias("batch_id"), "received_at", F.col("k").alias("api_key"), "source", "points")
    out = {r.batch_id: (r.status, r.accepted) for r in auth.ingest_status(df, keyed(spark), 1, 60).collect()}
    assert out == {1: (401, 0), 2: (403, 0), 3: (202, 1), 4: (429, 0), 5: (401, 0), 6: (202, 1), 7: (401, 0)}


@pytest.mark.parametrize("mode, want", [("epoch", [True, True, False, True]), ("anchored", [True, True, False, False])])
def test_rate_limit_modes(spark, mode, want):
    rows = [(i, 1, f"2034-02-06 12:00:{t}") for i, t in enumerate(("30", "40", "50"))] + [(3, 1, "2034-02-06 12:01:10")]
    df = spark.createDataFrame(rows, "batch_id long, key_id int, t string").select("batch_id", "key_id", F.to_timestamp("t").alias("received_at"))
    assert [r.allowed for r in auth.rate_limit(df, 2, 60, mode).orderBy("batch_id").collect()] == want


def test_rate_limit_knows_its_modes(spark):
    with pytest.raises(ValueError):
        auth.rate_limit(spark.range(1), mode="other")


def series_points(spark, rows):
    return spark.createDataFrame(rows, "batch_id long, pos int, received_at timestamp, tenant_id int, source_id int, name string, unit string, canonical string")


def test_series_identity_and_second_upsert(spark):
    t = dt.datetime(2034, 2, 6)
    pts = series_points(spark, [(2, 0, t, 1, 1, "n", "ms", '{"core":"0"}'), (1, 0, t, 1, 1, "n", "count", '{"core":"0"}'), (3, 0, t, 1, 1, "n", "count", '{"core":"1"}')])
    none = spark.createDataFrame([], lim.SERIES)
    first = resolve.upsert_series(pts, none)
    rows = {r.labels: (r.id, r.unit) for r in first.collect()}
    assert rows == {'{"core":"0"}': (1, "count"), '{"core":"1"}': (2, "count")}
    again = resolve.upsert_series(pts, spark.createDataFrame(first.collect(), lim.SERIES))
    assert sorted(r.id for r in again.collect()) == [1, 2]
    assert [(r.canonical, r.unit, r.units) for r in resolve.unit_conflicts(pts).collect()] == [('{"core":"0"}', "count", 2)]


def test_unknown_sources_keep_all_rows(spark):
    batches = spark.createDataFrame([(1, 1, "a", [1, 2, 3]), (2, 1, "b", [1])], "batch_id long, tenant_id int, source string, points array<int>")
    known, unknown = resolve.resolve_sources(batches, spark.createDataFrame([(9, 1, "b", 0, "{}", None)], lim.SOURCE))
    assert [r.source_id for r in known.collect()] == [9] and [(r.source, r.batches, r.points) for r in resolve.unknown_sources(unknown).collect()] == [("a", 1, 3)]


def test_weeks(spark):
    none = spark.createDataFrame([], "name string")
    made = retention.ensure_weeks(spark, none, dt.datetime(2031, 1, 8), 3)
    assert [r.name for r in made.orderBy("name").collect()] == ["metric_points_20310106", "metric_points_20310113", "metric_points_20310120"]
    assert retention.ensure_weeks(spark, made, dt.datetime(2031, 1, 8), 3).count() == 0
    names = spark.createDataFrame([(f"metric_points_{x}",) for x in ("20330606", "20330613", "20330620", "rogue_partition", "20330231")], "name string")
    verdict = {r.name[14:]: r.verdict for r in retention.judge_partitions(names, dt.datetime(2033, 6, 23), 0).collect()}
    assert verdict == {"20330606": "drop", "20330613": "drop", "20330620": "keep", "rogue_partition": "unknown", "20330231": "unknown"}
    with pytest.raises(ValueError):
        retention.ensure_weeks(spark, none, NOW, table="other")


def test_coverage_and_losses(spark):
    pts = spark.createDataFrame([(i, dt.datetime(2034, 2, 6) if i < 3 else dt.datetime(2045, 1, 1), 1.0) for i in range(30)], lim.POINT)
    inside, outside = points.split_covered(pts, spark.createDataFrame([(dt.datetime(2034, 2, 6),)], "week timestamp"))
    assert inside.count() == 3 and outside.count() == 27
    r = points.loss_summary(outside, ["week"]).first()
    assert (r.points, r.series, r.series_ids) == (27, 27, list(range(3, 23)))


def test_last_seen_can_go_back(spark):
    rows = [(1, dt.datetime(2035, 4, 2, 10), 1, [point(ts="2035-04-02T09:59:00Z")]), (1, dt.datetime(2035, 4, 2, 11), 2, [point(ts="2035-04-02T09:00:00Z"), point(ts="2035-04-02T08:00:00Z")])]
    df = spark.createDataFrame(rows, "source_id int, received_at timestamp, batch_id long, points array<struct<name:string,unit:string,ts:string,value:double,labels:map<string,string>>>")
    assert points.last_seen(df).first().last_seen_at == dt.datetime(2035, 4, 2, 9) and points.last_seen(df, "max").first().last_seen_at == dt.datetime(2035, 4, 2, 9, 59)


@pytest.mark.parametrize("line, want", [("cpu  100 20 30 700 40 5 5 0 0 0", (740, 900)), ("", None), ("cpu", None), ("cpu  100 20", None), ("cpu 1 2 3 4", None), ("intr 1 2 3 4 5 6 7 8", None), ("cpu 1 2 3 4 +5 6", None)])
def test_parse_cpu(spark, line, want):
    got = one(spark, host.parse_cpu(F.col("x")), x=line)
    assert (got and (got.idle, got.total)) == want


def cpu_line(idle, total):
    return f"cpu {total - idle} 0 0 {idle} 0 0"


@pytest.mark.parametrize("a, b, want", [((100, 200), (150, 300), 50.0), ((100, 200), (100, 200), None), ((200, 400), (100, 300), None), ((0, 0), (0, 100), 100.0), ((100, 400), (250, 500), 100.0)])
def test_cpu_usage(spark, a, b, want):
    t = dt.datetime(2034, 2, 6)
    rows = [("h", t, cpu_line(*a)), ("h", t + dt.timedelta(seconds=10), "cpu broken"), ("h", t + dt.timedelta(seconds=20), cpu_line(*b))]
    got = host.cpu_usage(spark.createDataFrame(rows, "host string, ts timestamp, content string")).collect()
    assert [r.usage for r in got] == [want]


@pytest.mark.parametrize("text, want", [("MemTotal: 984560 kB\nMemFree: 84332 kB\nMemAvailable:  563912 kB\nBuffers: 1 kB", (984560, 563912)), ("MemTotal: 1000 kB", None), ("MemTotal: 0 kB\nMemAvailable: 1 kB", None), ("MemTotal: x kB\nMemTotal: 5 kB\nMemAvailable: 1 kB", None)])
def test_parse_meminfo(spark, text, want):
    got = one(spark, host.parse_meminfo(F.col("x")), x=text)
    assert (got and (got.total_kb, got.available_kb)) == want


@pytest.mark.parametrize("text, want", [("123456.78 987654.32", 123456.78), ("not-a-number", None), ("", None), ("1.0d 2", None), ("1e3", 1000.0)])
def test_parse_uptime(spark, text, want):
    assert one(spark, host.parse_uptime(F.col("x")), x=text) == want


def test_host_metrics_fail_apart(spark):
    t = dt.datetime(2034, 2, 6)
    rows = [("h", t, cpu_line(1, 2), "broken", "5.0 1", 100.0, 25.0), ("h", t + dt.timedelta(seconds=10), cpu_line(2, 4), "MemTotal: 1000 kB\nMemAvailable: 5000 kB", "x", None, None)]
    df = spark.createDataFrame(rows, "host string, ts timestamp, stat string, meminfo string, uptime string, disk_total double, disk_free double")
    got = {(r.ts.second, r.name): r.value for r in host.host_metrics(df).collect()}
    assert got == {(0, "host.uptime_seconds"): 5.0, (0, "disk.used_percent"): 75.0, (0, "disk.free_bytes"): 25.0, (10, "cpu.usage"): 50.0, (10, "memory.used_percent"): 0.0, (10, "memory.available_bytes"): 5000 * 1024.0}


def test_spool(spark):
    df = spark.createDataFrame([("h", f"2031010{i}T0000000000000-000001-a.json", "{}", i == 1) for i in range(1, 5)], "host string, file_name string, payload string, in_flight boolean")
    assert sorted(r.file_name[7] for r in spool.spool_evict(df, 2).collect()) == ["1", "3", "4"]
    assert sorted(r.file_name[7] for r in spool.spool_evict(df.drop("in_flight"), 3).collect()) == ["2", "3", "4"]
    assert spool.spool_oldest(df).first().file_name[7] == "1"
    assert [(r.nth, r.file_name[7]) for r in spool.spool_replay(df.drop("in_flight"), 2).collect()] == [(1, "3"), (2, "4")]


def test_integrity(spark):
    keys = keyed(spark)
    asked = spark.createDataFrame([("key-a",), ("key-old",), ("unknown",)], "api_key string")
    new, missing = integrity.apply_revocations(keys, asked, dt.datetime(2036, 1, 1))
    assert {r.id: r.revoked_at for r in new.collect()}[1] == dt.datetime(2036, 1, 1) and missing.count() == 1
    assert {r.id: r.revoked_at for r in new.collect()}[3] == dt.datetime(2036, 1, 1)
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "t int, slug string")
    assert [(r.slug, r.rows) for r in integrity.find_duplicates(df, ["slug"]).collect()] == [("a", 2)]
    assert [r.t for r in integrity.find_orphans(df, "t", spark.createDataFrame([(1,)], "id int")).collect()] == [2]
    wide = spark.createDataFrame([(1, "n" * 201), (2, "n")], "id int, name string")
    assert [(r.key, r.column, r.length) for r in integrity.check_widths(wide, "sources").collect()] == [(1, "name", 201)]


def test_purge_sources(spark):
    tables = {"sources": spark.createDataFrame([(1,), (2,)], "id int"), "series": spark.createDataFrame([(10, 1), (20, 2)], "id int, source_id int"), "points": spark.createDataFrame([(10,), (20,), (20,)], "series_id int")}
    left = integrity.purge_sources(tables, spark.createDataFrame([(2,)], "id int"))
    assert [left[t].count() for t in ("sources", "series", "points")] == [1, 1, 1]


def test_scalar_functions_stay_in_the_engine(spark):
    df = spark.createDataFrame([(1, "a", {"k": "v"})], "id long, s string, l map<string,string>").select(s.canonical_labels(F.col("l")), s.name_ok(F.col("s")), s.utf16_len(F.col("s")), s.spool_parked_at(F.col("s")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_latest_points_limit_groups_first(spark):
    df = spark.createDataFrame([(1, NOW, 1.0)], lim.POINT).repartition(3)
    assert "WindowGroupLimit" in readback.latest_points(df, 2)._jdf.queryExecution().executedPlan().toString()
