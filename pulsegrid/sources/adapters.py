"""The library's tables, derived from the given star schema and event stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import key_hash, spool_name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def points_of(e: DataFrame) -> DataFrame:
    """One wire point per event, some of them bad in every way that the rules know."""
    i = F.col("event_id")
    name = F.concat(F.lit("event."), "event_type")
    plain = F.create_map(F.lit("k"), (F.col("k") % 3).cast("string"), F.lit("type"), F.col("event_type"))
    many = F.map_from_entries(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda n: F.struct(F.concat(F.lit("l"), n.cast("string")), F.lit("v"))))
    long_value = F.create_map(F.lit("k"), F.repeat(F.lit("x"), 129))
    long_text = F.create_map(F.lit("a"), F.repeat(F.lit("y"), 128), F.lit("b"), F.repeat(F.lit("z"), 128))
    return e.select(
        "event_id", "user_id",
        F.col("ts").alias("event_ts"),
        (F.col("user_id") % 7 + 1).cast("int").alias("tenant_id"),
        F.concat(F.lit("host-"), F.col("user_id").cast("string")).alias("source"),
        F.struct(
            F.when(i % 97 == 0, F.upper(name)).otherwise(name).alias("name"),
            F.when(i % 59 == 0, "  ").when(i % 31 == 0, "ms").otherwise("count").alias("unit"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ts"),
            F.when(i % 53 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"),
            F.when(i % 43 == 0, long_value).when(i % 47 == 0, long_text).when(i % 61 == 0, many).otherwise(plain).alias("labels"),
        ).alias("point"),
    )


def single_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request of one point per event; of 16 one comes before its point, and one comes too late."""
    p = points_of(events(spark, sf_dir))
    late = F.make_interval(secs=(F.col("event_id") % 16) * 43200 - 600)
    return p.select(F.col("event_id").alias("batch_id"), (F.col("event_ts") + late).alias("received_at"), "tenant_id", "source", F.array("point").alias("points"))


def daily_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per user and day; users divisible by 13 send theirs eight days late."""
    p = points_of(events(spark, sf_dir))
    g = p.groupBy("user_id", "tenant_id", "source", F.to_date("event_ts").alias("day")).agg(
        F.min("event_id").alias("batch_id"), F.max("event_ts").alias("last"), F.collect_list(F.struct("event_id", "point")).alias("points")
    )
    by_event = F.array_sort("points", lambda x, y: F.when(x["event_id"] < y["event_id"], -1).when(x["event_id"] > y["event_id"], 1).otherwise(0))
    g = g.withColumn("points", F.transform(by_event, lambda x: x["point"]))
    wait = F.when(F.col("user_id") % 13 == 0, F.expr("INTERVAL '8 00:00:01' DAY TO SECOND")).otherwise(F.expr("INTERVAL '0 00:00:01' DAY TO SECOND"))
    suppliers = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("_n"))
    key = F.concat(F.lit("key-"), (F.col("user_id") % (F.col("_n") + 5)).cast("string"))
    # one row, the count of suppliers
    return g.crossJoin(F.broadcast(suppliers)).select("batch_id", (F.col("last") + wait).alias("received_at"), key.alias("api_key"), "user_id", "tenant_id", "source", "points")


def request_lines(requests: DataFrame) -> DataFrame:
    """received_at and value: requests as lines of a log."""
    stamp = F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("received_at")
    return requests.select("received_at", F.to_json(F.struct("batch_id", stamp, "api_key", F.to_json(F.struct("source", "points")).alias("body"))).alias("value"))


def odd_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per user that may have a blank or long source, and no point, one, as many as are allowed, or one more."""
    first = F.min_by("point", "event_id").alias("point")
    g = points_of(events(spark, sf_dir)).groupBy("user_id").agg(F.min("event_id").alias("batch_id"), F.max("event_ts").alias("received_at"), first)
    names = [F.lit("host"), F.lit("  "), F.lit("\u3000"), F.repeat(F.lit("s"), 200), F.repeat(F.lit("s"), 201)]
    sizes = F.get(F.array(*map(F.lit, (1, 0, 1000, 1001))), (F.col("user_id") % 4).cast("int"))
    return g.select("batch_id", "received_at", F.get(F.array(*names), (F.col("user_id") % 5).cast("int")).alias("source"), F.array_repeat("point", sizes).alias("points"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source per user, but for those divisible by 11."""
    u = table(spark, sf_dir, "events").where("user_id % 11 <> 0").select("user_id").distinct()
    return u.select(
        (F.col("user_id") + 1).cast("int").alias("id"), (F.col("user_id") % 7 + 1).cast("int").alias("tenant_id"), F.concat(F.lit("host-"), F.col("user_id").cast("string")).alias("name"),
        F.lit(0).alias("kind"), F.lit("{}").alias("config"), F.lit(None).cast("timestamp").alias("last_seen_at"),
    )


def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.cast("int").alias("id"), (k % 7 + 1).cast("int").alias("tenant_id"), key_hash(F.concat(F.lit("key-"), k.cast("string"))).alias("key_hash"), F.col("s_name").alias("label"),
        F.when(k % 10 < 8, 0).when(k % 10 == 8, 1).otherwise(2).alias("scope"), F.lit("2023-12-01").cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("last_used_at"),
        F.when(k % 5 == 0, F.lit("2024-01-15").cast("timestamp")).alias("revoked_at"),
    )


def series_id() -> Column:
    """One id for supplier, return flag and line status."""
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return (F.col("l_suppkey") * 6 + flag * 2 + F.when(F.col("l_linestatus") == "F", 0).otherwise(1)).cast("int")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point facts from line items: series_id, ts, value, week, and the row's own keys for ties."""
    ts = F.col("l_shipdate").cast("timestamp")
    return table(spark, sf_dir, "lineitem").select(series_id().alias("series_id"), ts.alias("ts"), F.col("l_extendedprice").alias("value"), F.date_trunc("week", ts).alias("week"), "l_orderkey", "l_linenumber", "l_partkey")


def fact_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select(series_id().alias("id"), F.col("l_suppkey").cast("int").alias("source_id"), "l_returnflag", "l_linestatus").distinct()
    labels = F.concat(F.lit('{"flag":"'), "l_returnflag", F.lit('","status":"'), "l_linestatus", F.lit('"}'))
    return d.select("id", (F.col("source_id") % 7 + 1).cast("int").alias("tenant_id"), "source_id", F.lit("line.price").alias("name"), F.lit("usd").alias("unit"), labels.alias("labels"))


def fact_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").cast("int").alias("id"), (F.col("s_suppkey") % 7 + 1).cast("int").alias("tenant_id"), F.col("s_name").alias("name"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """/proc snapshots per user: counters from event ids that run back every 40th time, and lines that are broken."""
    e, i = events(spark, sf_dir), F.col("event_id")
    user, idle = F.when(i % 40 == 0, i % 7).otherwise(i * 10), F.when(i % 40 == 0, i % 5).otherwise(i * 7 + i % 90)
    stat = F.when(i % 53 == 0, "cpu broken").otherwise(F.format_string("cpu  %d 0 0 %d 0 0\ncpu0 1 2 3 4 5 6", user, idle))
    total, free = 1000 + i % 977, F.when(i % 29 == 0, i % 977 + 5000).otherwise(i % 977)
    available = F.when(i % 37 == 0, F.lit("")).otherwise(F.format_string("MemAvailable:    %d kB\n", free))
    memory = F.concat(F.format_string("MemTotal:       %d kB\nMemFree:  12 kB\n", F.when(i % 41 == 0, F.lit(0).cast("long")).otherwise(total)), available)
    uptime = F.when(i % 31 == 0, "not-a-number").otherwise(F.format_string("%d.5 9.0\n", i))
    return e.select(
        F.concat(F.lit("host-"), F.col("user_id").cast("string")).alias("host"), "ts", i, stat.alias("stat"), memory.alias("meminfo"), uptime.alias("uptime"),
        F.when(i % 19 != 0, (i % 11 * 100).cast("double")).alias("disk_total"), (i % 13 * 50).cast("double").alias("disk_free"),
    )


def spool_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points_of(events(spark, sf_dir))
    name = spool_name(F.col("event_ts"), F.col("event_id") % 1000000, F.concat(F.lit("t"), (F.col("event_id") % 10).cast("string")))
    payload = F.to_json(F.struct("source", F.array("point").alias("points")))
    return p.select(F.col("source").alias("host"), name.alias("file_name"), payload.alias("payload"), "event_id")
