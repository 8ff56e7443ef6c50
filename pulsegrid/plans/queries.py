"""The registered queries over the given tables, each beside the SQL that says the same."""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import limits as lim
from pulsegrid.functions import scalars as s
from pulsegrid.operators import auth, host, integrity, points, readback, resolve, retention, rollup, spool, validate
from pulsegrid.plans import rollups, store
from pulsegrid.plans.ingest import ingest
from pulsegrid.sources import adapters as a
from pulsegrid.sources import jdbc
from pulsegrid.sources import tables as files
from pulsegrid.sources.scratch import scratch_path, written
from pulsegrid.sources.spool import park
from pulsegrid.sources.spool import spool_stream as spool_stream_of
from pulsegrid.sources.tables import read_facts, write_points
from pulsegrid.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = dt.datetime(2001, 6, 20)
DAY = 86_400


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def ntz(df: DataFrame) -> DataFrame:
    """Instants as UTC wall-clock time, the type that the SQL side has."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


# -- SQL that several queries share --------------------------------------------------------------------------------

EVENTS = "e AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"
POINTS = (
    EVENTS
    + """, p AS (
  SELECT event_id, user_id, ts, CAST(user_id % 7 + 1 AS INTEGER) AS tenant_id, 'host-' || user_id AS source,
    CASE WHEN event_id % 97 = 0 THEN upper('event.' || event_type) ELSE 'event.' || event_type END AS name,
    CASE WHEN event_id % 59 = 0 THEN '  ' WHEN event_id % 31 = 0 THEN 'ms' ELSE 'count' END AS unit, value,
    '{"k":"' || (k % 3) || '","type":"' || event_type || '"}' AS canonical,
    event_id % 97 = 0 AS bad_name, event_id % 59 = 0 AS bad_unit, event_id % 53 = 0 AS bad_value,
    event_id % 43 = 0 AS bad_length, event_id % 43 <> 0 AND event_id % 47 = 0 AS bad_total,
    event_id % 43 <> 0 AND event_id % 47 <> 0 AND event_id % 61 = 0 AS bad_count
  FROM e), q AS (
  SELECT *, bad_name OR bad_unit OR bad_value OR bad_length OR bad_total OR bad_count AS bad FROM p)"""
)
SINGLE = (
    POINTS
    + """, r AS (
  SELECT *, ts + to_seconds((event_id % 16) * 43200 - 600) AS received_at FROM q), f AS (
  SELECT *, ts > received_at + INTERVAL 5 MINUTE AS future, ts < received_at - INTERVAL 7 DAY AS old FROM r)"""
)
DAILY = (
    POINTS
    + """, n AS (
  SELECT user_id, tenant_id, source, CAST(ts AS DATE) AS day, min(event_id) AS batch_id, count(*) AS n_points, max(ts) AS last_ts,
    max(ts) + INTERVAL 1 SECOND + CASE WHEN user_id % 13 = 0 THEN INTERVAL 8 DAY ELSE INTERVAL 0 DAY END AS received_at,
    'key-' || (user_id % ((SELECT count(*) FROM supplier) + 5)) AS api_key, bool_or(bad) AS bad_point
  FROM q GROUP BY user_id, tenant_id, source, CAST(ts AS DATE)), m AS (
  SELECT n.*, bad_point OR user_id % 13 = 0 AS bad FROM n), pn AS (
  SELECT q.*, n.batch_id, n.received_at, CAST(row_number() OVER (PARTITION BY n.batch_id ORDER BY q.event_id) - 1 AS INTEGER) AS pos
  FROM q JOIN n ON q.user_id = n.user_id AND CAST(q.ts AS DATE) = n.day)"""
)
SOURCES = "src AS (SELECT DISTINCT CAST(user_id + 1 AS INTEGER) AS source_id, CAST(user_id % 7 + 1 AS INTEGER) AS tenant_id, 'host-' || user_id AS source FROM events WHERE user_id % 11 <> 0)"
KEYS = """keys AS (
  SELECT CAST(s_suppkey AS INTEGER) AS id, CAST(s_suppkey % 7 + 1 AS INTEGER) AS tenant_id, sha256('key-' || s_suppkey) AS key_hash, s_name AS label,
    CASE WHEN s_suppkey % 10 < 8 THEN 0 WHEN s_suppkey % 10 = 8 THEN 1 ELSE 2 END AS scope,
    CASE WHEN s_suppkey % 5 = 0 THEN TIMESTAMP '2024-01-15' END AS revoked_at FROM supplier)"""
STATUS = (
    DAILY
    + ", "
    + KEYS
    + """, au AS (
  SELECT m.*, keys.id AS key_id, keys.tenant_id AS key_tenant, keys.scope FROM m LEFT JOIN keys
  ON sha256(m.api_key) = keys.key_hash AND (keys.revoked_at IS NULL OR m.received_at < keys.revoked_at)), rl AS (
  SELECT *, CASE WHEN scope = 0 THEN row_number() OVER (
    PARTITION BY CASE WHEN scope = 0 THEN key_id END, floor(epoch_us(received_at) / 86400000000) ORDER BY received_at, batch_id) END AS nth FROM au), st AS (
  SELECT *, CASE WHEN key_id IS NULL THEN 401 WHEN scope <> 0 THEN 403 WHEN nth > 2 THEN 429 WHEN bad THEN 400 ELSE 202 END AS status FROM rl)"""
)
#: The points of valid daily requests whose source is registered, with the order of arrival.
VALID = DAILY + ", " + SOURCES + ", v AS (SELECT pn.*, src.source_id FROM pn JOIN m USING (batch_id) JOIN src ON src.source = pn.source AND src.tenant_id = pn.tenant_id WHERE NOT m.bad)"
FACTS = """f AS (
  SELECT CAST(l_suppkey * 6 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END * 2 + CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS INTEGER) AS series_id,
    CAST(l_suppkey AS INTEGER) AS source_id, CAST(l_suppkey % 7 + 1 AS INTEGER) AS tenant_id, CAST(l_shipdate AS TIMESTAMP) AS ts, CAST(date_trunc('week', l_shipdate) AS TIMESTAMP) AS week,
    l_extendedprice AS value, l_returnflag, l_linestatus, l_orderkey, l_linenumber, l_partkey FROM lineitem)"""


# -- scalar functions ----------------------------------------------------------------------------------------------


@query(
    """WITH n AS (SELECT event_id, 'event.' || event_type AS b FROM events), v AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN b WHEN 1 THEN upper(b) WHEN 2 THEN b || '..x'
  WHEN 3 THEN '.' || b WHEN 4 THEN b || '.' WHEN 5 THEN b || ' y' WHEN 6 THEN repeat('a', 127 + CAST(event_id % 4 AS INTEGER)) WHEN 7 THEN b || chr(10) ELSE b || '_9' END AS name FROM n)
SELECT event_id, regexp_full_match(name, '[a-z0-9_]+([.][a-z0-9_]+)*') AND length(name) <= 128 AS ok FROM v"""
)
def metric_name_ok(spark, sf_dir):
    b, i = F.concat(F.lit("event."), "event_type"), F.col("event_id")
    forms = [b, F.upper(b), F.concat(b, F.lit("..x")), F.concat(F.lit("."), b), F.concat(b, F.lit(".")), F.concat(b, F.lit(" y")), F.repeat(F.lit("a"), (i % 4 + 127).cast("int")), F.concat(b, F.lit("\n")), F.concat(b, F.lit("_9"))]
    return a.table(spark, sf_dir, "events").select("event_id", s.name_ok(F.get(F.array(*forms), (i % 9).cast("int"))).alias("ok"))


@query(
    "WITH "
    + EVENTS
    + r""" SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '{}' ELSE '{"a\\\"":"x","k":"' || replace(replace(event_type || '\' || k || '"', '\', '\\'), '"', '\"') || '","user":"' || user_id || '"}' END AS labels FROM e"""
)
def canonical_labels(spark, sf_dir):
    e = a.events(spark, sf_dir)
    labels = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit('a\\"'), F.lit("x"), F.lit("k"), F.concat("event_type", F.lit("\\"), F.col("k").cast("string"), F.lit('"')))
    return e.select("event_id", s.canonical_labels(F.when(F.col("event_id") % 10 != 0, labels)).alias("labels"))


@query("SELECT c_custkey, sha256('key-' || c_custkey || c_name) AS key_hash FROM customer")
def key_hash(spark, sf_dir):
    return a.table(spark, sf_dir, "customer").select("c_custkey", s.key_hash(F.concat(F.lit("key-"), F.col("c_custkey").cast("string"), "c_name")).alias("key_hash"))


@query(
    """WITH o AS (SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS week FROM orders)
SELECT o_orderkey, week, 'metric_points_' || strftime(week, '%Y%m%d') AS name, strftime(week, '%Y-%m-%d %H:%M:%S') || '+00:00' AS lower, strftime(week + INTERVAL 7 DAY, '%Y-%m-%d %H:%M:%S') || '+00:00' AS upper FROM o"""
)
def week_start_and_name(spark, sf_dir):
    week = s.week_start(F.col("o_orderdate").cast("timestamp"))
    o = a.table(spark, sf_dir, "orders").select("o_orderkey", week.alias("week"))
    return ntz(o.select("o_orderkey", "week", s.partition_name("metric_points", F.col("week")).alias("name"), s.week_bounds(F.col("week")).alias("b")).select("o_orderkey", "week", "name", "b.lower", "b.upper"))


NAMES = """CASE o_orderkey % 6 WHEN 0 THEN 'metric_points_' || strftime(o_orderdate, '%Y%m%d') WHEN 1 THEN 'metric_points_rogue' WHEN 2 THEN 'metric_points_20240231'
  WHEN 3 THEN 'other_' || strftime(o_orderdate, '%Y%m%d') WHEN 4 THEN 'metric_points_' || strftime(o_orderdate, '%Y%m%d') || '0' ELSE 'metric_points_' || strftime(date_trunc('week', o_orderdate), '%Y%m%d') END"""
PARSED = "CAST(CASE WHEN regexp_full_match(name, 'metric_points_[0-9]{8}') THEN try_strptime(substr(name, 15), '%Y%m%d') END AS TIMESTAMP)"


def partition_names(spark, sf_dir):
    i, day, monday = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyyMMdd"), F.date_format(F.date_trunc("week", "o_orderdate"), "yyyyMMdd")
    p = F.lit("metric_points_")
    forms = [F.concat(p, day), F.lit("metric_points_rogue"), F.lit("metric_points_20240231"), F.concat(F.lit("other_"), day), F.concat(p, day, F.lit("0")), F.concat(p, monday)]
    return a.table(spark, sf_dir, "orders").select("o_orderkey", F.get(F.array(*forms), (i % 6).cast("int")).alias("name"))


@query(f"WITH n AS (SELECT o_orderkey, {NAMES} AS name FROM orders) SELECT o_orderkey, name, {PARSED} AS week FROM n")
def parse_partition_name(spark, sf_dir):
    return ntz(partition_names(spark, sf_dir).select("o_orderkey", "name", s.parse_partition_name("metric_points", F.col("name")).alias("week")))


@query(
    """WITH n AS (SELECT event_id, ts, strftime(ts, '%Y%m%dT%H%M%S%f') || '0-' || lpad(CAST(event_id % 1000000 AS VARCHAR), 6, '0') || '-t' || (event_id % 10) || '.json' AS good FROM events)
SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'x' || good WHEN 2 THEN substr(good, 3) ELSE good END AS file_name, CASE WHEN event_id % 5 IN (1, 2) THEN TIMESTAMP '1970-01-01' ELSE ts END AS parked_at FROM n"""
)
def spool_parked_at(spark, sf_dir):
    f, i = a.spool_files(spark, sf_dir), F.col("event_id")
    name = F.when(i % 5 == 1, F.concat(F.lit("x"), "file_name")).when(i % 5 == 2, F.substring("file_name", 3, 99)).otherwise(F.col("file_name"))
    return ntz(f.select("event_id", name.alias("file_name")).withColumn("parked_at", s.spool_parked_at(F.col("file_name"))))


@query(
    """WITH v AS (SELECT event_id, CAST(event_id % 11 * 100 AS DOUBLE) AS total, CAST(event_id % 17 * 75 AS DOUBLE) AS rest FROM events)
SELECT event_id, round(CASE WHEN total > 0 THEN greatest(CAST(0 AS DOUBLE), least(CAST(100 AS DOUBLE), 100 * (total - rest) / total)) ELSE CAST(0 AS DOUBLE) END, 6) AS used FROM v"""
)
def used_percent(spark, sf_dir):
    i = F.col("event_id")
    return a.table(spark, sf_dir, "events").select("event_id", F.round(s.used_percent((i % 11 * 100).cast("double"), (i % 17 * 75).cast("double")), 6).alias("used"))


@query("SELECT doc_id, CAST(length(text) + 4 AS INTEGER) AS units FROM documents")
def utf16_len(spark, sf_dir):
    return a.table(spark, sf_dir, "documents").select("doc_id", s.utf16_len(F.concat("text", F.lit("\U0001f600\U0001f600"))).alias("units"))


STATUSES = [200, 202, 400, 401, 403, 404, 405, 408, 413, 415, 429, 500, 502, 503, 504, 599]


@query(
    f"""WITH v AS (SELECT event_id, list_extract({STATUSES}, CAST(event_id % 16 + 1 AS BIGINT)) AS status FROM events)
SELECT event_id, CASE WHEN status = 202 THEN 'accepted' WHEN status IN (400, 401, 403, 404, 405, 413, 415) THEN 'rejected' ELSE 'retry' END AS outcome FROM v"""
)
def publish_outcome(spark, sf_dir):
    status = F.get(F.array(*[F.lit(x) for x in STATUSES]), (F.col("event_id") % 16).cast("int"))
    return a.table(spark, sf_dir, "events").select("event_id", s.classify_outcome(status).alias("outcome"))


SCOPE_TEXTS = ["ingest", "read", "control", "Control", "admin", ""]


@query(
    f"""WITH v AS (SELECT event_id, list_extract({SCOPE_TEXTS}, CAST(event_id % 6 + 1 AS BIGINT)) AS granted, list_extract({SCOPE_TEXTS}, CAST(event_id // 6 % 6 + 1 AS BIGINT)) AS required FROM events)
SELECT event_id, (granted = required AND granted IN ('ingest', 'read', 'control')) OR (granted = 'control' AND required = 'read') AS ok,
  CASE lower(granted) WHEN 'ingest' THEN 0 WHEN 'read' THEN 1 WHEN 'control' THEN 2 END AS scope, CASE event_id % 3 WHEN 0 THEN 'ingest' WHEN 1 THEN 'read' ELSE 'control' END AS name FROM v"""
)
def scope_satisfies(spark, sf_dir):
    texts, i = F.array(*[F.lit(x) for x in SCOPE_TEXTS]), F.col("event_id")
    granted, required = F.get(texts, (i % 6).cast("int")), F.get(texts, (F.floor(i / 6) % 6).cast("int"))
    return a.table(spark, sf_dir, "events").select("event_id", s.scope_satisfies(granted, required).alias("ok"), s.parse_scope(granted).alias("scope"), s.scope_name(i % 3).alias("name"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN ts WHEN 1 THEN ts - INTERVAL 2 HOUR WHEN 2 THEN ts + INTERVAL 330 MINUTE END AS utc FROM events")
def to_utc(spark, sf_dir):
    i, wall = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    wire = F.when(i % 4 == 0, F.concat(wall, F.lit("Z"))).when(i % 4 == 1, F.concat(wall, F.lit("+02:00"))).when(i % 4 == 2, F.concat(wall, F.lit("-05:30"))).otherwise("no time")
    return ntz(a.table(spark, sf_dir, "events").select("event_id", s.to_utc(wire).alias("utc")))


# -- validation ----------------------------------------------------------------------------------------------------

REASONS = [("name", "bad_name"), ("unit", "bad_unit"), ("value", "bad_value"), ("ts_future", "future"), ("ts_old", "old"), ("label_count", "bad_count"), ("label_length", "bad_length"), ("label_total", "bad_total")]


@query("WITH " + SINGLE + " SELECT event_id AS batch_id, concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, c in REASONS) + ") AS reasons FROM f")
def validate_points(spark, sf_dir):
    checked = validate.with_reasons(a.single_requests(spark, sf_dir))
    return checked.select("batch_id", F.array_join(F.get("point_reasons", F.lit(0)), ",").alias("reasons"))


@query("WITH " + DAILY + " SELECT batch_id, n_points, NOT bad AS accepted FROM m")
def validate_batches(spark, sf_dir):
    good, rejects = validate.validate_batches(a.daily_requests(spark, sf_dir))
    return good.select("batch_id", F.size("points").cast("long").alias("n_points"), F.lit(True).alias("accepted")).unionByName(rejects.select("batch_id", "n_points", F.lit(False).alias("accepted")))


@query(
    "WITH " + DAILY + ", x AS (SELECT *, FALSE AS future, user_id % 13 = 0 AS old FROM pn) " + " UNION ALL ".join(f"SELECT batch_id, pos, '{r}' AS reason, '{lim.MESSAGES[r]}' AS message FROM x WHERE {c}" for r, c in REASONS)
)
def validation_errors(spark, sf_dir):
    return validate.validation_errors(a.daily_requests(spark, sf_dir))


# -- authentication and status -------------------------------------------------------------------------------------


@query("WITH " + STATUS + " SELECT batch_id, key_id, key_tenant AS tenant_id, CASE scope WHEN 0 THEN 'ingest' WHEN 1 THEN 'read' WHEN 2 THEN 'control' END AS scope FROM au")
def authenticate(spark, sf_dir):
    return auth.authenticate(a.daily_requests(spark, sf_dir), a.api_keys(spark, sf_dir)).select("batch_id", "key_id", "tenant_id", "scope")


@query(
    "WITH e AS (SELECT event_id AS batch_id, user_id AS key_id, ts AS received_at FROM events) SELECT batch_id, row_number() OVER (PARTITION BY key_id, floor(epoch_us(received_at) / 86400000000) ORDER BY received_at, batch_id) <= 2 AS allowed FROM e"
)
def rate_limit(spark, sf_dir):
    requests = a.events(spark, sf_dir).select(F.col("event_id").alias("batch_id"), F.col("user_id").alias("key_id"), F.col("ts").alias("received_at"))
    return auth.rate_limit(requests, 2, DAY).select("batch_id", "allowed")


@query(
    """WITH RECURSIVE e AS (SELECT event_id, user_id, ts FROM events), w AS (
  SELECT user_id, min(ts) AS start FROM e GROUP BY user_id UNION ALL
  SELECT w.user_id, (SELECT min(ts) FROM e WHERE e.user_id = w.user_id AND e.ts >= w.start + INTERVAL 1 DAY) AS start FROM w WHERE w.start IS NOT NULL), x AS (
  SELECT e.event_id, e.user_id, e.ts, max(w.start) AS start FROM e JOIN w ON w.user_id = e.user_id AND w.start <= e.ts GROUP BY ALL)
SELECT event_id AS batch_id, row_number() OVER (PARTITION BY user_id, start ORDER BY ts, event_id) <= 2 AS allowed FROM x"""
)
def rate_limit_anchored(spark, sf_dir):
    requests = a.events(spark, sf_dir).select(F.col("event_id").alias("batch_id"), F.col("user_id").alias("key_id"), F.col("ts").alias("received_at"))
    return auth.rate_limit(requests, 2, DAY, mode="anchored").select("batch_id", "allowed")


@query("WITH " + STATUS + " SELECT batch_id, status, CASE WHEN status = 202 THEN n_points ELSE 0 END AS accepted FROM st")
def ingest_status(spark, sf_dir):
    return auth.ingest_status(a.daily_requests(spark, sf_dir), a.api_keys(spark, sf_dir), 2, DAY).select("batch_id", "status", "accepted")


@query("WITH " + STATUS + " SELECT key_tenant AS tenant_id, status, count(*) AS requests, CAST(sum(CASE WHEN status = 202 THEN n_points ELSE 0 END) AS BIGINT) AS accepted FROM st GROUP BY ALL")
def ingest_funnel(spark, sf_dir):
    return auth.ingest_funnel(auth.ingest_status(a.daily_requests(spark, sf_dir), a.api_keys(spark, sf_dir), 2, DAY))


# -- sources and series --------------------------------------------------------------------------------------------


def valid_requests(spark, sf_dir):
    return validate.validate_batches(a.daily_requests(spark, sf_dir))[0]


def valid_points(spark, sf_dir):
    known, _ = resolve.resolve_sources(valid_requests(spark, sf_dir), a.sources(spark, sf_dir))
    return resolve.with_canonical(validate.explode_points(known.select("batch_id", "received_at", "tenant_id", "source_id", "points")))


def known_series(spark, sf_dir, found=None):
    """The dimension as some of the batches have made it: series of every third batch, numbered. found: the valid points, if they are there already."""
    found = valid_points(spark, sf_dir) if found is None else found
    old = resolve.series_seen(found.where(F.col("batch_id") % 3 == 0))
    rows = old.select("tenant_id", "source_id", "name", "unit", F.col("canonical").alias("labels"), "created_at")
    return resolve.assign_ids(rows, ["tenant_id", "source_id", "name", "labels"], 1).select("id", "tenant_id", "source_id", "name", "unit", "labels", "created_at")


FIRST = "arg_min(unit, (received_at, batch_id, pos)) AS unit"
SERIES = "SELECT tenant_id, source_id, name, canonical"
OLD = f", old AS ({SERIES}, {FIRST}, min(received_at) AS created_at FROM v WHERE batch_id % 3 = 0 GROUP BY tenant_id, source_id, name, canonical), alls AS ({SERIES}, {FIRST}, min(received_at) AS created_at FROM v GROUP BY tenant_id, source_id, name, canonical)"
FRESH = ", fresh AS (SELECT alls.* FROM alls ANTI JOIN old USING (tenant_id, source_id, name, canonical))"


@query("WITH " + DAILY + ", " + SOURCES + " SELECT m.batch_id, src.source_id FROM m LEFT JOIN src ON src.source = m.source AND src.tenant_id = m.tenant_id WHERE NOT m.bad")
def resolve_sources(spark, sf_dir):
    known, unknown = resolve.resolve_sources(valid_requests(spark, sf_dir), a.sources(spark, sf_dir))
    return known.select("batch_id", "source_id").unionByName(unknown.select("batch_id", F.lit(None).cast("int").alias("source_id")))


@query(
    "WITH " + DAILY + ", " + SOURCES + " SELECT m.tenant_id, m.source, count(*) AS batches, CAST(sum(n_points) AS BIGINT) AS points FROM m ANTI JOIN src ON src.source = m.source AND src.tenant_id = m.tenant_id WHERE NOT m.bad GROUP BY ALL"
)
def unknown_sources(spark, sf_dir):
    return resolve.unknown_sources(resolve.resolve_sources(valid_requests(spark, sf_dir), a.sources(spark, sf_dir))[1])


@query("WITH " + VALID + OLD + FRESH + " SELECT tenant_id, source_id, name, canonical, unit, created_at FROM fresh")
def new_series(spark, sf_dir):
    found = written(valid_points(spark, sf_dir), "valid")
    return ntz(resolve.new_series(found, known_series(spark, sf_dir, found)))


@query(
    "WITH " + VALID + OLD + FRESH + ", numbered AS (SELECT 0 AS part, * FROM old UNION ALL SELECT 1 AS part, * FROM fresh) SELECT CAST(row_number() OVER (ORDER BY part, tenant_id, source_id, name, canonical) AS INTEGER) AS id, tenant_id, source_id, name, unit, canonical AS labels, created_at FROM numbered"
)
def upsert_series(spark, sf_dir):
    """The stored dimension, grown twice, and a third time by nothing new."""
    path, found = scratch_path(spark, "series"), written(valid_points(spark, sf_dir), "valid")
    for part in (found.where(F.col("batch_id") % 3 == 0), found, found):
        store.append_series(part, path)
    return ntz(store.read_series(spark, path))


@query("WITH " + VALID + OLD + " SELECT batch_id, pos, v.tenant_id, v.source_id, v.name, v.canonical, v.unit FROM v JOIN old USING (tenant_id, source_id, name, canonical)")
def resolve_series(spark, sf_dir):
    valid = written(valid_points(spark, sf_dir), "valid")
    found = resolve.resolve_series(valid, known_series(spark, sf_dir, valid))
    return found.select("batch_id", "pos", "tenant_id", "source_id", "name", "canonical", "unit")


@query("WITH " + VALID + f" {SERIES}, {FIRST}, count(DISTINCT unit) AS units FROM v GROUP BY tenant_id, source_id, name, canonical HAVING count(DISTINCT unit) > 1")
def unit_conflicts(spark, sf_dir):
    return resolve.unit_conflicts(valid_points(spark, sf_dir))


CARDINALITY = " SELECT tenant_id, source_id, name, count(*) AS series FROM old GROUP BY ALL"


@query("WITH " + VALID + OLD + CARDINALITY)
def series_cardinality(spark, sf_dir):
    return resolve.series_cardinality(known_series(spark, sf_dir))


@query("WITH " + VALID + OLD + CARDINALITY + " ORDER BY series DESC, tenant_id, source_id, name LIMIT 10")
def top_cardinality(spark, sf_dir):
    return resolve.top_cardinality(known_series(spark, sf_dir), 10)


@query(None)
def approx_cardinality(spark, sf_dir):
    return resolve.approx_cardinality(valid_points(spark, sf_dir))


# -- points --------------------------------------------------------------------------------------------------------

WEEKS = ", weeks AS (SELECT DISTINCT week FROM f WHERE week < TIMESTAMP '2001-01-01')"


def early_weeks(spark, sf_dir):
    return a.facts(spark, sf_dir).where("week < timestamp '2001-01-01'").select("week").distinct()


@query("WITH " + FACTS + WEEKS + " SELECT week, week IN (SELECT week FROM weeks) AS covered, count(*) AS points FROM f GROUP BY ALL")
def split_covered(spark, sf_dir):
    inside, outside = points.split_covered(a.facts(spark, sf_dir).drop("week"), early_weeks(spark, sf_dir))
    both = inside.select("week", F.lit(True).alias("covered")).unionByName(outside.select("week", F.lit(False).alias("covered")))
    return ntz(both.groupBy("week", "covered").agg(F.count(F.lit(1)).alias("points")))


@query(
    "WITH " + FACTS + WEEKS + ", lost AS (SELECT * FROM f WHERE week NOT IN (SELECT week FROM weeks)) SELECT week, count(*) AS points, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT series_id) AS series, array_to_string(list_slice(list_sort(list_distinct(list(series_id))), 1, 20), ',') AS series_ids FROM lost GROUP BY week"
)
def loss_summary(spark, sf_dir):
    lost = points.split_covered(a.facts(spark, sf_dir).drop("week"), early_weeks(spark, sf_dir))[1]
    return ntz(points.loss_summary(lost, ["week"]).withColumn("series_ids", F.array_join(F.col("series_ids").cast("array<string>"), ",")))


@query(
    "WITH " + STATUS + ", " + SOURCES + """, g AS (SELECT CASE st.status WHEN 401 THEN 'unauthorized' WHEN 403 THEN 'forbidden' WHEN 429 THEN 'rate_limited' WHEN 400 THEN 'invalid' ELSE 'unknown_source' END AS reason, n_points
  FROM st LEFT JOIN src ON src.source = st.source AND src.tenant_id = st.key_tenant WHERE st.status <> 202 OR src.source_id IS NULL)
SELECT reason, CAST(sum(n_points) AS BIGINT) AS points FROM g GROUP BY reason"""
)
def dropped_by_reason(spark, sf_dir):
    return points.dropped_by_reason(ingest(a.daily_requests(spark, sf_dir), a.api_keys(spark, sf_dir), a.sources(spark, sf_dir), 2, DAY).rejects)


@query(
    "WITH " + DAILY + ", " + SOURCES + " SELECT src.source_id, arg_max(last_ts, (received_at, batch_id)) AS last_seen_at, max(last_ts) AS latest FROM m JOIN src ON src.source = m.source AND src.tenant_id = m.tenant_id GROUP BY src.source_id"
)
def last_seen(spark, sf_dir):
    known, _ = resolve.resolve_sources(a.daily_requests(spark, sf_dir), a.sources(spark, sf_dir))
    return ntz(points.last_seen(known).join(points.last_seen(known, "max").withColumnRenamed("last_seen_at", "latest"), "source_id"))


@query("WITH " + FACTS + " SELECT week, count(*) AS points, count(DISTINCT series_id) AS series, round(sum(value), 2) AS total FROM f GROUP BY week")
def write_points_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "points")
    write_points(a.facts(spark, sf_dir).select("series_id", "ts", "value"), path)
    back = read_facts(spark, path).groupBy("week").agg(F.count(F.lit(1)).alias("points"), F.count_distinct("series_id").alias("series"), F.round(F.sum("value"), 2).alias("total"))
    return ntz(back)


# -- retention -----------------------------------------------------------------------------------------------------

JUDGED = f"n AS (SELECT DISTINCT {NAMES} AS name FROM orders), j AS (SELECT name, {PARSED} AS week FROM n)"


@query(
    "WITH " + JUDGED + """, w AS (SELECT CAST(date_trunc('week', TIMESTAMP '2001-06-20') AS TIMESTAMP) + to_days(CAST(7 * i AS INTEGER)) AS week FROM range(0, 12) t(i)),
x AS (SELECT 'metric_points_' || strftime(week, '%Y%m%d') AS name, week, strftime(week, '%Y-%m-%d %H:%M:%S') || '+00:00' AS lower, strftime(week + INTERVAL 7 DAY, '%Y-%m-%d %H:%M:%S') || '+00:00' AS upper FROM w)
SELECT x.* FROM x ANTI JOIN (SELECT name FROM n WHERE right(name, 1) <> '2') k USING (name)"""
)
def ensure_weeks(spark, sf_dir):
    existing = partition_names(spark, sf_dir).select("name").distinct().where("right(name, 1) <> '2'")
    return ntz(retention.ensure_weeks(spark, existing, AS_OF, 12))


@query("WITH " + JUDGED + " SELECT name, week, CASE WHEN week IS NULL THEN 'unknown' WHEN week + INTERVAL 7 DAY <= TIMESTAMP '2001-06-13' THEN 'drop' ELSE 'keep' END AS verdict FROM j")
def expired_weeks(spark, sf_dir):
    return ntz(retention.judge_partitions(partition_names(spark, sf_dir).select("name").distinct(), AS_OF))


@query("WITH " + FACTS + " SELECT week, count(*) AS points FROM f WHERE NOT week + INTERVAL 7 DAY <= TIMESTAMP '2001-06-13' GROUP BY week")
def apply_retention(spark, sf_dir):
    return ntz(retention.apply_retention(a.facts(spark, sf_dir), AS_OF).groupBy("week").agg(F.count(F.lit(1)).alias("points")))


# -- reading back --------------------------------------------------------------------------------------------------


@query("WITH " + FACTS + " SELECT tenant_id, count(*) AS points FROM f GROUP BY tenant_id")
def points_per_tenant(spark, sf_dir):
    return readback.points_per_tenant(a.facts(spark, sf_dir), a.fact_series(spark, sf_dir))


@query("WITH " + FACTS + " SELECT series_id, count(*) AS points FROM f GROUP BY series_id")
def points_per_series(spark, sf_dir):
    return readback.points_per_series(a.facts(spark, sf_dir))


@query("WITH " + FACTS + " SELECT source_id, tenant_id, s_name AS source, count(*) AS points FROM f JOIN supplier ON s_suppkey = source_id GROUP BY ALL")
def points_by_source(spark, sf_dir):
    return readback.points_by_source(a.facts(spark, sf_dir), a.fact_series(spark, sf_dir), a.fact_sources(spark, sf_dir))


TIES = ["value", "l_orderkey", "l_linenumber", "l_partkey"]


@query(
    "WITH " + FACTS + " SELECT series_id, ts, value, CAST(row_number() OVER (PARTITION BY series_id ORDER BY ts DESC, value DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS INTEGER) AS rank FROM f QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY ts DESC, value DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) <= 5"
)
def latest_points(spark, sf_dir):
    return ntz(readback.latest_points(a.facts(spark, sf_dir), 5, TIES).select("series_id", "ts", "value", "rank"))


@query(
    "WITH " + FACTS + """ SELECT s_name AS source, 'line.price' AS name, 'usd' AS unit, '{"flag":"' || l_returnflag || '","status":"' || l_linestatus || '"}' AS labels, ts, value
FROM f JOIN supplier ON s_suppkey = source_id WHERE f.tenant_id = 3 AND ts >= TIMESTAMP '2000-02-01' AND ts < TIMESTAMP '2000-08-01'"""
)
def read_points(spark, sf_dir):
    return ntz(readback.read_points(a.facts(spark, sf_dir), a.fact_series(spark, sf_dir), a.fact_sources(spark, sf_dir), 3, dt.datetime(2000, 2, 1), dt.datetime(2000, 8, 1)))


# -- hosts ---------------------------------------------------------------------------------------------------------

CPU = """c AS (SELECT event_id, 'host-' || user_id AS host, ts, event_id % 53 <> 0 AS good,
  CASE WHEN event_id % 40 = 0 THEN event_id % 5 ELSE event_id * 7 + event_id % 90 END AS idle,
  CASE WHEN event_id % 40 = 0 THEN event_id % 7 ELSE event_id * 10 END + CASE WHEN event_id % 40 = 0 THEN event_id % 5 ELSE event_id * 7 + event_id % 90 END AS total FROM events)"""
USAGE = """, d AS (SELECT *, idle - lag(idle) OVER w AS di, total - lag(total) OVER w AS dt FROM c WHERE good WINDOW w AS (PARTITION BY host ORDER BY ts)), u AS (
  SELECT event_id, host, ts, CASE WHEN dt <= 0 OR di < 0 THEN NULL WHEN di > dt THEN CAST(100 AS DOUBLE) ELSE greatest(CAST(0 AS DOUBLE), least(CAST(100 AS DOUBLE), CAST(100 AS DOUBLE) * (dt - di) / dt)) END AS usage FROM d WHERE dt IS NOT NULL)"""


@query("WITH " + CPU + " SELECT event_id, CASE WHEN good THEN idle END AS idle, CASE WHEN good THEN total END AS total FROM c")
def parse_cpu(spark, sf_dir):
    snaps = a.snapshots(spark, sf_dir)
    return snaps.select("event_id", host.parse_cpu(F.substring_index("stat", "\n", 1)).alias("c")).select("event_id", "c.idle", "c.total")


@query("WITH " + CPU + USAGE + " SELECT host, ts, round(usage, 6) AS usage FROM u")
def cpu_usage(spark, sf_dir):
    lines = a.snapshots(spark, sf_dir).select("host", "ts", F.substring_index("stat", "\n", 1).alias("content"))
    return ntz(host.cpu_usage(lines).withColumn("usage", F.round("usage", 6)))


MEMORY = """mm AS (SELECT event_id, event_id % 37 <> 0 AND event_id % 41 <> 0 AS ok, 1000 + event_id % 977 AS total, CASE WHEN event_id % 29 = 0 THEN event_id % 977 + 5000 ELSE event_id % 977 END AS free FROM events)"""


@query("WITH " + MEMORY + " SELECT event_id, CASE WHEN ok THEN total END AS total_kb, CASE WHEN ok THEN free END AS available_kb FROM mm")
def parse_meminfo(spark, sf_dir):
    return a.snapshots(spark, sf_dir).select("event_id", host.parse_meminfo(F.col("meminfo")).alias("m")).select("event_id", "m.total_kb", "m.available_kb")


@query("SELECT event_id, CASE WHEN event_id % 31 <> 0 THEN CAST(event_id || '.5' AS DOUBLE) END AS seconds FROM events")
def parse_uptime(spark, sf_dir):
    return a.snapshots(spark, sf_dir).select("event_id", host.parse_uptime(F.col("uptime")).alias("seconds"))


PERCENT = "CASE WHEN {t} > 0 THEN greatest(CAST(0 AS DOUBLE), least(CAST(100 AS DOUBLE), 100.0 * ({t} - {r}) / {t})) ELSE CAST(0 AS DOUBLE) END"
HOST = (
    CPU + USAGE + ", " + MEMORY + """, dd AS (SELECT event_id, 'host-' || user_id AS host, ts, CAST(event_id % 11 * 100 AS DOUBLE) AS t, CAST(event_id % 13 * 50 AS DOUBLE) AS r, event_id % 19 <> 0 AS has, event_id % 31 <> 0 AS up FROM events), h AS (
  SELECT host, ts, 'cpu.usage' AS name, 'percent' AS unit, usage AS value FROM u WHERE usage IS NOT NULL
  UNION ALL SELECT host, ts, 'memory.used_percent', 'percent', """ + PERCENT.format(t="CAST(total AS DOUBLE)", r="CAST(free AS DOUBLE)") + """ FROM mm JOIN dd USING (event_id) WHERE ok
  UNION ALL SELECT host, ts, 'memory.available_bytes', 'bytes', free * CAST(1024 AS DOUBLE) FROM mm JOIN dd USING (event_id) WHERE ok
  UNION ALL SELECT host, ts, 'disk.used_percent', 'percent', """ + PERCENT.format(t="t", r="r") + """ FROM dd WHERE has
  UNION ALL SELECT host, ts, 'disk.free_bytes', 'bytes', r FROM dd WHERE has
  UNION ALL SELECT host, ts, 'host.uptime_seconds', 'seconds', CAST(event_id || '.5' AS DOUBLE) FROM dd WHERE up)"""
)


@query("WITH " + HOST + " SELECT host, ts, name, unit, round(value, 6) AS value FROM h")
def host_metrics(spark, sf_dir):
    return ntz(host.host_metrics(a.snapshots(spark, sf_dir)).withColumn("value", F.round("value", 6)))


@query("WITH " + HOST + " SELECT host, ts, host AS source, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names, min(ts) AS stamp, round(sum(value), 3) AS total FROM h GROUP BY host, ts")
def build_payloads(spark, sf_dir):
    payloads = host.build_payloads(host.host_metrics(a.snapshots(spark, sf_dir)))
    read = payloads.withColumn("b", F.from_json("payload", lim.WIRE_REQUEST))
    total = F.aggregate("b.points", F.lit(0.0), lambda x, p: x + p["value"])
    stamp = F.array_min(F.transform("b.points", lambda p: s.to_utc(p["ts"])))
    return ntz(read.select("host", "ts", "b.source", F.size("b.points").cast("long").alias("n"), F.array_join("b.points.name", ",").alias("names"), stamp.alias("stamp"), F.round(total, 3).alias("total")))


# -- spool ---------------------------------------------------------------------------------------------------------

FILES = """fl AS (SELECT event_id, 'host-' || user_id AS host, ts, strftime(ts, '%Y%m%dT%H%M%S%f') || '0-' || lpad(CAST(event_id % 1000000 AS VARCHAR), 6, '0') || '-t' || (event_id % 10) || '.json' AS file_name FROM events)"""


@query("WITH " + FILES + " SELECT host, file_name FROM fl QUALIFY row_number() OVER (PARTITION BY host ORDER BY file_name DESC) <= 20 OR event_id % 101 = 0")
def spool_evict(spark, sf_dir):
    return spool.spool_evict(a.spool_files(spark, sf_dir).withColumn("in_flight", F.col("event_id") % 101 == 0), 20).select("host", "file_name")


@query("WITH " + FILES + " SELECT host, min(file_name) AS file_name, min(ts) AS parked_at FROM fl GROUP BY host")
def spool_oldest(spark, sf_dir):
    return ntz(spool.spool_oldest(a.spool_files(spark, sf_dir)))


@query(
    "WITH " + FILES + ", kept AS (SELECT * FROM fl QUALIFY row_number() OVER (PARTITION BY host ORDER BY file_name DESC) <= 20), " + POINTS + " SELECT kept.host, file_name, CAST(row_number() OVER (PARTITION BY kept.host ORDER BY file_name) AS INTEGER) AS nth, kept.ts AS parked_at, q.source, q.name FROM kept JOIN q USING (event_id)"
)
def spool_replay(spark, sf_dir):
    out = spool.spool_replay(a.spool_files(spark, sf_dir), 20)
    return ntz(out.select("host", "file_name", "nth", "parked_at", "source", F.get("points", F.lit(0))["name"].alias("name")))


# -- integrity -----------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def find_duplicates(spark, sf_dir):
    return integrity.find_duplicates(a.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3)")
def find_orphans(spark, sf_dir):
    parents = a.table(spark, sf_dir, "customer").where("c_custkey % 10 <> 3")
    return integrity.find_orphans(a.table(spark, sf_dir, "orders"), "o_custkey", parents, "c_custkey").select("o_orderkey", "o_custkey")


@query(
    "WITH " + FACTS + ", " + KEYS + """ SELECT 'tenants' AS tab, count(DISTINCT tenant_id) AS rows FROM keys WHERE tenant_id NOT IN (2, 5) UNION ALL SELECT 'api_keys', count(*) FROM keys WHERE tenant_id NOT IN (2, 5)
UNION ALL SELECT 'sources', count(*) FROM keys WHERE tenant_id NOT IN (2, 5) UNION ALL SELECT 'series', count(DISTINCT series_id) FROM f WHERE tenant_id NOT IN (2, 5) UNION ALL SELECT 'points', count(*) FROM f WHERE tenant_id NOT IN (2, 5)"""
)
def purge_tenants(spark, sf_dir):
    sources = a.fact_sources(spark, sf_dir)
    tenants = sources.select(F.col("tenant_id").alias("id")).distinct()
    tables = {"tenants": tenants, "api_keys": a.api_keys(spark, sf_dir), "sources": sources, "series": a.fact_series(spark, sf_dir), "points": a.facts(spark, sf_dir)}
    left = integrity.purge_tenants(tables, tenants.where("id in (2, 5)"))
    counts = [t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("tab"), "rows") for n, t in left.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("WITH " + KEYS + " SELECT id, CASE WHEN id % 4 = 1 THEN TIMESTAMP '2024-02-01' + to_days(id % 3) ELSE revoked_at END AS revoked_at FROM keys")
def apply_revocations(spark, sf_dir):
    k = F.col("s_suppkey")
    asked = a.table(spark, sf_dir, "supplier").where(k % 4 == 1).select(F.concat(F.lit("key-"), k.cast("string")).alias("api_key"), (F.lit("2024-02-01").cast("timestamp") + F.make_interval(days=(k % 3).cast("int"))).alias("revoked_at"))
    return ntz(integrity.apply_revocations(a.api_keys(spark, sf_dir), asked)[0].select("id", "revoked_at"))


@query("SELECT CAST(c_custkey AS INTEGER) AS key, 'name' AS \"column\", CAST(length(c_name) * (1 + c_custkey % 20) AS INTEGER) AS length FROM customer WHERE length(c_name) * (1 + c_custkey % 20) > 200")
def check_widths(spark, sf_dir):
    k = F.col("c_custkey")
    table = a.table(spark, sf_dir, "customer").select(k.cast("int").alias("id"), F.repeat("c_name", (k % 20 + 1).cast("int")).alias("name"))
    return integrity.check_widths(table, "sources")


# -- the whole path, rollups ---------------------------------------------------------------------------------------


ACCEPTED = STATUS + ", " + SOURCES + ", g AS (SELECT st.batch_id, st.received_at, st.last_ts, st.key_tenant AS tenant_id, src.source_id FROM st JOIN src ON src.source = st.source AND src.tenant_id = st.key_tenant WHERE st.status = 202)"
NO_WEEK = dt.datetime(2024, 1, 15)


def ingest_dims(spark, sf_dir):
    """Keys, sources, and the weeks that exist: one week of the events is missing."""
    weeks = a.events(spark, sf_dir).select(s.week_start(F.col("ts")).alias("week")).distinct().where(F.col("week") != F.lit(NO_WEEK))
    return {"api_keys": a.api_keys(spark, sf_dir), "sources": a.sources(spark, sf_dir), "weeks": weeks}


def stored_points(spark, path):
    g = store.read_points_of(spark, path).groupBy("tenant_id", "name", "week").agg(
        F.count(F.lit(1)).alias("points"), F.count_distinct("series_id").alias("series"), F.round(F.sum("value"), 2).alias("total"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    return ntz(g)


def rejected_points(spark, path):
    return store.read_rejects(spark, path).groupBy("reason").agg(F.count(F.lit(1)).alias("rejects"), F.sum("n_points").alias("points"))


def ingested_once(spark, sf_dir):
    path = scratch_path(spark, "ingest")
    store.ingest_epoch(a.daily_requests(spark, sf_dir), ingest_dims(spark, sf_dir), path, 0, 2, DAY)
    return path


@query(
    "WITH " + ACCEPTED + """ SELECT g.tenant_id, pn.name, CAST(date_trunc('week', pn.ts) AS TIMESTAMP) AS week, count(*) AS points, count(DISTINCT (g.source_id, pn.canonical)) AS series, round(sum(pn.value), 2) AS total, min(pn.ts) AS first_ts, max(pn.ts) AS last_ts
FROM pn JOIN g USING (batch_id) WHERE date_trunc('week', pn.ts) <> TIMESTAMP '2024-01-15' GROUP BY ALL"""
)
def ingest_end_to_end(spark, sf_dir):
    """Requests through every stage to points by week, read back by their series' natural key."""
    return stored_points(spark, ingested_once(spark, sf_dir))


@query(
    "WITH " + ACCEPTED + """, x AS (SELECT CASE st.status WHEN 401 THEN 'unauthorized' WHEN 403 THEN 'forbidden' WHEN 429 THEN 'rate_limited' WHEN 400 THEN 'invalid' ELSE 'unknown_source' END AS reason, n_points
  FROM st ANTI JOIN g USING (batch_id) UNION ALL SELECT 'no_partition', 1 FROM pn JOIN g USING (batch_id) WHERE date_trunc('week', pn.ts) = TIMESTAMP '2024-01-15')
SELECT reason, count(*) AS rejects, CAST(sum(n_points) AS BIGINT) AS points FROM x GROUP BY reason"""
)
def ingest_rejects(spark, sf_dir):
    """What the same path rejects, written by reason."""
    return rejected_points(spark, ingested_once(spark, sf_dir))


MINUTES = """mi AS (SELECT user_id AS series_id, date_trunc('minute', ts) AS bucket, count(*) AS n, sum(value) AS total, min(value) AS least, max(value) AS most, arg_max(value, (ts, value)) AS last FROM events GROUP BY ALL)"""


def event_points(spark, sf_dir):
    return a.events(spark, sf_dir).select(F.col("user_id").alias("series_id"), "ts", "value")


@query("WITH " + MINUTES + " SELECT series_id, CAST(bucket AS TIMESTAMP) AS bucket, n, round(total, 4) AS total, least, most, last FROM mi")
def rollup_1m(spark, sf_dir):
    return ntz(rollup.rollup_1m(event_points(spark, sf_dir)).withColumn("total", F.round("total", 4)))


@query(
    "WITH " + MINUTES + ", ho AS (SELECT series_id, CAST(date_trunc('hour', bucket) AS TIMESTAMP) AS bucket, CAST(sum(n) AS BIGINT) AS n, sum(total) AS total, min(least) AS least, max(most) AS most, arg_max(last, mi.bucket) AS last FROM mi GROUP BY series_id, date_trunc('hour', mi.bucket)) SELECT series_id, bucket, n, round(total, 4) AS total, least, most, last, round(total / n, 4) AS mean FROM ho"
)
def rollup_1h(spark, sf_dir):
    hours = rollup.rollup_1h(rollup.rollup_1m(event_points(spark, sf_dir)))
    return ntz(hours.withColumn("total", F.round("total", 4)).withColumn("mean", F.round("mean", 4)))


# -- streams, run to the end of what is there; the SQL is that of the batch form ------------------------------------


def streamed(spark: SparkSession, batch: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream makes of a table: the table is written as files, read as a stream, and run until it is used up."""
    path = scratch_path(spark, "stream")
    batch.write.parquet(f"{path}/in")
    out = build(spark.readStream.schema(batch.schema).parquet(f"{path}/in"))
    run = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


@query(ORACLE_SQL["cpu_usage"])
def cpu_usage_stream(spark, sf_dir):
    lines = a.snapshots(spark, sf_dir).select("host", "ts", F.substring_index("stat", "\n", 1).alias("content"))
    return ntz(streamed(spark, lines, jobs.cpu_usage_stream).withColumn("usage", F.round("usage", 6)))


@query(ORACLE_SQL["rate_limit"])
def rate_limit_stream(spark, sf_dir):
    requests = a.events(spark, sf_dir).select(F.col("event_id").alias("batch_id"), F.col("user_id").alias("key_id"), F.col("ts").alias("received_at"))
    return streamed(spark, requests, lambda r: jobs.rate_limit_stream(r, 2, DAY)).select("batch_id", "allowed")


@query("SELECT user_id AS series_id, ts, value FROM events")
def dedupe_stream(spark, sf_dir):
    twice = event_points(spark, sf_dir)
    return ntz(streamed(spark, twice.unionAll(twice), jobs.dedupe_stream))


@functools.lru_cache(maxsize=4)
def ingested_stream(spark, sf_dir):
    """Request logs of three spans of time, streamed one after the other, each as a micro-batch of its own."""
    path = scratch_path(spark, "ingest")
    lines = written(a.request_lines(a.daily_requests(spark, sf_dir)), "lines")
    spans = [dt.datetime(1970, 1, 1), dt.datetime(2024, 1, 11), dt.datetime(2024, 1, 22, 7), dt.datetime(2100, 1, 1)]
    dims = lambda: ingest_dims(spark, sf_dir)
    for lo, hi in zip(spans, spans[1:]):
        lines.where((F.col("received_at") >= F.lit(lo)) & (F.col("received_at") < F.lit(hi))).select("value").write.mode("append").text(f"{path}/in")
        jobs.ingest_stream(files.request_stream(spark, f"{path}/in", 10_000), dims, f"{path}/out", f"{path}/state", 2, DAY, {"availableNow": True}).awaitTermination()
    return f"{path}/out"


@query(ORACLE_SQL["ingest_end_to_end"])
def ingest_stream(spark, sf_dir):
    return stored_points(spark, ingested_stream(spark, sf_dir))


@query(ORACLE_SQL["ingest_rejects"])
def ingest_stream_rejects(spark, sf_dir):
    return rejected_points(spark, ingested_stream(spark, sf_dir))


@query("WITH " + ACCEPTED + " SELECT source_id AS id, arg_max(last_ts, (received_at, batch_id)) AS last_seen_at FROM g GROUP BY source_id")
def ingest_stream_last_seen(spark, sf_dir):
    seen = store.read_sources(a.sources(spark, sf_dir), ingested_stream(spark, sf_dir))
    return ntz(seen.where("last_seen_at is not null").select("id", "last_seen_at"))


# -- files, limits of batches, foreign keys, purges -----------------------------------------------------------------


@query("WITH " + DAILY + " SELECT m.batch_id, m.api_key, m.source, m.received_at, n_points, max(pn.name) AS last_name, round(sum(CASE WHEN pn.event_id % 53 = 0 THEN 0 ELSE pn.value END), 4) AS total FROM m JOIN pn USING (batch_id) GROUP BY ALL")
def read_requests(spark, sf_dir):
    """Request logs written as JSON lines and read back."""
    path, requests = scratch_path(spark, "logs"), a.daily_requests(spark, sf_dir)
    a.request_lines(requests).select("value").write.text(path)
    back = files.read_requests(spark, path)
    total = F.aggregate("points", F.lit(0.0), lambda x, p: x + F.when(F.isnan(p["value"]), 0.0).otherwise(p["value"]))
    return ntz(back.select("batch_id", "api_key", "source", "received_at", F.size("points").cast("long").alias("n_points"), F.array_max("points.name").alias("last_name"), F.round(total, 4).alias("total")))


@query(
    "WITH " + FACTS + ", " + KEYS + """ SELECT 'tenants' AS tab, tenant_id, count(DISTINCT tenant_id) AS rows FROM keys GROUP BY tenant_id UNION ALL SELECT 'api_keys', tenant_id, count(*) FROM keys GROUP BY tenant_id
UNION ALL SELECT 'sources', tenant_id, count(*) FROM keys GROUP BY tenant_id UNION ALL SELECT 'series', tenant_id, count(DISTINCT series_id) FROM f GROUP BY tenant_id"""
)
def load_dims(spark, sf_dir):
    """The dimension tables, written as Parquet and read with their schemas."""
    path, no_time = scratch_path(spark, "dims"), F.lit(None).cast("timestamp")
    sources = a.fact_sources(spark, sf_dir)
    tenants = sources.select(F.col("tenant_id").alias("id")).distinct().select("id", F.concat(F.lit("tenant-"), F.col("id").cast("string")).alias("name"), F.col("id").cast("string").alias("slug"), no_time.alias("created_at"))
    sources = sources.select("id", "tenant_id", "name", F.lit(0).alias("kind"), F.lit("{}").alias("config"), no_time.alias("last_seen_at"))
    for name, table in {"tenants": tenants, "api_keys": a.api_keys(spark, sf_dir), "sources": sources, "series": a.fact_series(spark, sf_dir).withColumn("created_at", no_time)}.items():
        table.write.parquet(f"{path}/{name}")
    out = None
    for name, table in files.load_dims(spark, path).items():
        part = table.groupBy(F.col("id" if name == "tenants" else "tenant_id").alias("tenant_id")).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("tab"), "tenant_id", "rows")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    """WITH u AS (SELECT user_id, min(event_id) AS batch_id FROM events GROUP BY user_id), v AS (SELECT *, user_id % 5 IN (1, 2, 4) AS bad_source, user_id % 4 = 1 AS empty, user_id % 4 = 3 AS large FROM u)
SELECT batch_id, concat_ws(',', CASE WHEN bad_source THEN 'source' END, CASE WHEN empty THEN 'batch_empty' END, CASE WHEN large THEN 'batch_too_large' END) AS reasons FROM v"""
)
def batch_limits(spark, sf_dir):
    """Sources that are blank or too long, batches without points and with too many."""
    return validate.with_reasons(a.odd_requests(spark, sf_dir)).select("batch_id", F.array_join("batch_reasons", ",").alias("reasons"))


@query(ORACLE_SQL["host_metrics"])
def proc_snapshots(spark, sf_dir):
    """Host metrics from snapshots in long form."""
    wide = a.snapshots(spark, sf_dir)
    long = wide.select("host", "ts", F.expr("stack(3, 'stat', stat, 'meminfo', meminfo, 'uptime', uptime) as (kind, content)"))
    disks = wide.select("host", "ts", F.col("disk_total").alias("total_bytes"), F.col("disk_free").alias("free_bytes"))
    return ntz(host.host_metrics(host.parse_proc_snapshots(long, disks)).withColumn("value", F.round("value", 6)))


@query(
    "WITH " + FACTS + ", " + KEYS + """, se AS (SELECT DISTINCT series_id, tenant_id, source_id FROM f)
SELECT 'api_keys.tenant_id' AS fk, count(*) AS orphans FROM keys WHERE tenant_id IN (2, 5) UNION ALL SELECT 'sources.tenant_id', count(*) FROM keys WHERE tenant_id IN (2, 5)
UNION ALL SELECT 'series.tenant_id', count(*) FROM se WHERE tenant_id IN (2, 5) UNION ALL SELECT 'series.source_id', count(*) FROM se WHERE source_id % 9 = 4 UNION ALL SELECT 'points.series_id', count(*) FROM f WHERE series_id % 11 = 3"""
)
def orphan_checks(spark, sf_dir):
    """Every foreign key, with some of the parents gone."""
    sources, series = a.fact_sources(spark, sf_dir), a.fact_series(spark, sf_dir)
    tenants = sources.select(F.col("tenant_id").alias("id")).distinct().where("id not in (2, 5)")
    checks = {
        "api_keys.tenant_id": (a.api_keys(spark, sf_dir), "tenant_id", tenants), "sources.tenant_id": (sources, "tenant_id", tenants), "series.tenant_id": (series, "tenant_id", tenants),
        "series.source_id": (series, "source_id", sources.where("id % 9 <> 4")), "points.series_id": (a.facts(spark, sf_dir), "series_id", series.where("id % 11 <> 3")),
    }
    out = None
    for name, (table, column, parents) in checks.items():
        part = integrity.find_orphans(table, column, parents).agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(name).alias("fk"), "orphans")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "WITH " + FACTS + ", " + KEYS + """ SELECT 'sources' AS tab, CAST(NULL AS TIMESTAMP) AS week, count(*) AS rows FROM keys WHERE id % 9 <> 4 UNION ALL SELECT 'series', NULL, count(DISTINCT series_id) FROM f WHERE source_id % 9 <> 4
UNION ALL SELECT 'points', week, count(*) FROM f WHERE source_id % 9 <> 4 GROUP BY week"""
)
def purge_sources(spark, sf_dir):
    """Sources and what hangs from them; of the stored points only the weeks concerned are written anew."""
    path, sources, series = scratch_path(spark, "points"), a.fact_sources(spark, sf_dir), a.fact_series(spark, sf_dir)
    write_points(a.facts(spark, sf_dir).select("series_id", "ts", "value"), path)
    gone = sources.where("id % 9 = 4")
    left = integrity.purge_sources({"sources": sources, "series": series, "points": a.facts(spark, sf_dir)}, gone)
    files.purge_points(spark, path, series.join(gone.select(F.col("id").alias("source_id")), "source_id", "left_semi"))
    no_week, rows = F.lit(None).cast("timestamp").alias("week"), F.count(F.lit(1)).alias("rows")
    counts = [left[t].agg(rows).select(F.lit(t).alias("tab"), no_week, "rows") for t in ("sources", "series")]
    points_left = read_facts(spark, path).groupBy("week").agg(rows).select(F.lit("points").alias("tab"), "week", "rows")
    return ntz(counts[0].unionByName(counts[1]).unionByName(points_left))


# -- tables at rest over many epochs ---------------------------------------------------------------------------------


@query(
    """WITH w AS (SELECT event_id, user_id, value, CAST(date_trunc('week', ts) AS TIMESTAMP) AS week FROM events),
l AS (SELECT * FROM w WHERE (event_id % 3 <> 0 OR user_id % 11 <> 3) AND week >= TIMESTAMP '2024-01-15')
SELECT k.week, CASE WHEN k.week >= TIMESTAMP '2024-01-15' THEN 'keep' ELSE 'drop' END AS verdict, count(l.event_id) AS points, count(DISTINCT user_id) AS series, coalesce(round(sum(value), 2), 0) AS total
FROM (SELECT DISTINCT week FROM w) k LEFT JOIN l ON l.week = k.week GROUP BY k.week"""
)
def stored_weeks(spark, sf_dir):
    """Points of one epoch, a purge of series, two more epochs, compaction, retention; what is left by week, with retention's verdict."""
    path = scratch_path(spark, "weeks")
    found = a.events(spark, sf_dir).select("event_id", F.col("user_id").cast("int").alias("series_id"), "ts", "value")
    for epoch in range(3):
        write_points(found.where(F.col("event_id") % 3 == epoch), path)
        if epoch == 0:
            files.purge_points(spark, path, found.where("series_id % 11 = 3").select(F.col("series_id").alias("id")).distinct())
    files.compact_points(spark, path)
    judged = files.retire_weeks(spark, path, dt.datetime(2024, 1, 24), 7)
    left = read_facts(spark, path).groupBy("week").agg(F.count(F.lit(1)).alias("points"), F.count_distinct("series_id").alias("series"), F.round(F.sum("value"), 2).alias("total"))
    weeks = judged.select(F.to_timestamp("week").alias("week"), "verdict")
    return ntz(weeks.join(left, "week", "left").na.fill(0, ["points", "series", "total"]))


@functools.lru_cache(maxsize=4)
def rolled_up(spark, sf_dir):
    """Points of events, streamed in three micro-batches; each brings points of the whole month, so that nearly all of the later ones are late."""
    path = scratch_path(spark, "rolled")
    found = a.events(spark, sf_dir).select("event_id", F.col("user_id").cast("int").alias("series_id"), "ts", "value")
    schema = found.drop("event_id").schema
    for turn in range(3):
        found.where(F.col("event_id") % 3 == turn).drop("event_id").write.mode("append").parquet(f"{path}/in")
        jobs.rollup_stream(spark.readStream.schema(schema).parquet(f"{path}/in"), f"{path}/out", f"{path}/state", {"availableNow": True}).awaitTermination()
    return f"{path}/out"


@query(ORACLE_SQL["rollup_1m"])
def rollup_stored_1m(spark, sf_dir):
    minutes = rollups.stored_rollup(spark, rolled_up(spark, sf_dir), "minutes")
    return ntz(minutes.select(F.col("series_id").cast("long").alias("series_id"), "bucket", "n", F.round("total", 4).alias("total"), "least", "most", "last"))


@query(ORACLE_SQL["rollup_1h"])
def rollup_stored_1h(spark, sf_dir):
    hours = rollups.stored_rollup(spark, rolled_up(spark, sf_dir), "hours").withColumn("mean", F.round(F.col("total") / F.col("n"), 4))
    return ntz(hours.select(F.col("series_id").cast("long").alias("series_id"), "bucket", "n", F.round("total", 4).alias("total"), "least", "most", "last", "mean"))


@query(ORACLE_SQL["rollup_1h"])
def rollup_1h_stream(spark, sf_dir):
    """Minutes and hours in one stream; a point of no series, far ahead, lets the watermark pass all others."""
    found, end = event_points(spark, sf_dir), F.lit("2100-01-01").cast("timestamp")
    path = scratch_path(spark, "hours")
    found.write.parquet(f"{path}/in")
    for _ in range(2):
        out = jobs.rollup_1h_stream(spark.readStream.schema(found.schema).parquet(f"{path}/in"), "40 days")
        out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
        spark.range(1).select((F.col("id") - 1).alias("series_id"), end.alias("ts"), F.lit(0.0).alias("value")).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in found.schema]).write.mode("append").parquet(f"{path}/in")
    hours = spark.read.schema(out.schema).parquet(f"{path}/out").where("series_id >= 0")
    return ntz(hours.withColumn("total", F.round("total", 4)).withColumn("mean", F.round("mean", 4)))


@query("WITH " + VALID + " SELECT tenant_id, name, count(DISTINCT (source_id, canonical)) AS series, TRUE AS within FROM v WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' GROUP BY tenant_id, name")
def sketch_cardinality(spark, sf_dir):
    """The exact number of series over a span of days, and whether that from stored sketches of single days is within four standard errors."""
    path, found = scratch_path(spark, "sketches"), valid_points(spark, sf_dir)
    resolve.cardinality_sketches(found).write.parquet(path)
    first, last = dt.date(2024, 1, 5), dt.date(2024, 1, 19)
    guess = resolve.cardinality_between(spark.read.parquet(path), first, last).withColumnRenamed("series", "guess")
    exact = found.where(F.to_date("ts").between(F.lit(first), F.lit(last))).groupBy("tenant_id", "name").agg(F.count_distinct("source_id", "canonical").alias("series"))
    error = F.abs(F.col("guess") - F.col("series")) / F.col("series")
    return exact.join(guess, ["tenant_id", "name"], "left").select("tenant_id", "name", "series", F.coalesce(error <= 4 * resolve.SKETCH_ERROR, F.lit(False)).alias("within"))


@query(ORACLE_SQL["dropped_by_reason"])
def losses_stream(spark, sf_dir):
    """Points lost by reason, as a listener has added them up over the micro-batches of a stream of rejects."""
    rejects = ingest(a.daily_requests(spark, sf_dir), a.api_keys(spark, sf_dir), a.sources(spark, sf_dir), 2, DAY).rejects
    path, counter = scratch_path(spark, "losses"), jobs.LossCounter()
    rejects.repartition(3).write.parquet(f"{path}/in")
    spark.streams.addListener(counter)
    try:
        stream = jobs.losses_stream(spark.readStream.schema(rejects.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"))
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
        counter.ended.wait(60)
    finally:
        spark.streams.removeListener(counter)
    return spark.createDataFrame(sorted(counter.points.items()), "reason string, points long")


SPOOLED = FILES + ", nf AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY file_name DESC) AS age FROM fl QUALIFY age <= 3)"


def spooled(spark, sf_dir, folder):
    """The three newest files of each host, as files in folders of their hosts."""
    park(spool.spool_evict(a.spool_files(spark, sf_dir), 3).select("host", "file_name", "payload"), folder)


@query(
    "WITH " + SPOOLED + ", " + POINTS + " SELECT host, file_name, ts AS parked_at, q.source, q.name FROM nf JOIN q USING (event_id, ts)"
)
def read_spool(spark, sf_dir):
    """Spool folders read back as requests, each with its parking time."""
    folder = scratch_path(spark, "spool")
    spooled(spark, sf_dir, folder)
    out = spool.spool_replay(files.read_spool(spark, folder))
    return ntz(out.select("host", "file_name", "parked_at", "source", F.get("points", F.lit(0))["name"].alias("name")))


@query("WITH " + SPOOLED + ", t AS (SELECT row_number() OVER (PARTITION BY host ORDER BY file_name) - 1 AS trigger FROM nf) SELECT trigger, count(*) AS files, count(*) AS points FROM t GROUP BY trigger")
def spool_stream(spark, sf_dir):
    """The same folders as a stream: files and points of each trigger, which takes one file of every host."""
    folder = scratch_path(spark, "spool")
    spooled(spark, sf_dir, folder)
    found = spool.spool_requests(spool_stream_of(spark, folder, 10**9))

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.select(F.lit(epoch).cast("long").alias("trigger"), "file_name", F.size("points").alias("n")).write.mode("append").parquet(f"{folder}-out")

    run = found.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}-state").start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    out = spark.read.schema("trigger long, file_name string, n int").parquet(f"{folder}-out")
    return out.groupBy("trigger").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("points"))


@query(
    "WITH e AS (SELECT user_id, event_type, value, CAST(date_trunc('week', ts) AS TIMESTAMP) AS week FROM events) SELECT CAST(user_id AS INTEGER) AS source_id, 'event.' || event_type AS name, week, count(*) AS points, round(sum(value), 3) AS total FROM e GROUP BY ALL"
)
def jdbc_roundtrip(spark, sf_dir):
    """Series and points in a relational database and back: series inserted twice are there once, points are read by weeks."""
    path = scratch_path(spark, "derby")
    db = {"url": f"jdbc:derby:memory:{path.rsplit('/', 1)[-1]};create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    spark.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    jdbc.create_tables(spark, db)
    e = a.events(spark, sf_dir).select(F.col("user_id").cast("int").alias("source_id"), F.concat(F.lit("event."), "event_type").alias("name"), "ts", "value")
    series = e.groupBy("source_id", "name").agg(F.min("ts").alias("created_at")).select((F.col("source_id") % 7 + 1).alias("tenant_id"), "source_id", "name", F.lit("count").alias("unit"), F.lit("{}").alias("labels"), "created_at")
    jdbc.add_series_jdbc(series.where("source_id % 2 = 0"), db)
    jdbc.add_series_jdbc(series, db)
    known = jdbc.read_series_jdbc(spark, db).select(F.col("id").alias("series_id"), "source_id", "name")
    jdbc.add_points_jdbc(e.join(known, ["source_id", "name"]), db)
    weeks = [f"{r.week:%Y-%m-%d}" for r in e.select(s.week_start(F.col("ts")).alias("week")).distinct().collect()]
    back = jdbc.read_points_jdbc(spark, db, sorted(weeks)).join(known, "series_id")
    return ntz(back.groupBy("source_id", "name", s.week_start(F.col("ts")).alias("week")).agg(F.count(F.lit(1)).alias("points"), F.round(F.sum("value"), 3).alias("total")))
