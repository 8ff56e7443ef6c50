"""Host metrics from collected /proc snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.functions.scalars import used_percent

# The six metrics that a host reports, with their units.
HOST_METRICS = {
    "cpu.usage": "percent",
    "memory.used_percent": "percent",
    "memory.available_bytes": "bytes",
    "disk.used_percent": "percent",
    "disk.free_bytes": "bytes",
    "host.uptime_seconds": "seconds",
}


def fields(line: Column) -> Column:
    return F.filter(F.split(line, " "), lambda x: x != "")


def parse_cpu(line: Column) -> Column:
    """struct(idle, total) of a cpu line, or null: six fields or more, the first "cpu", all others whole numbers.

    idle is idle and waiting time; total adds up all fields. Spark's longs stand for the unsigned counters.
    """
    parts = fields(line)
    numbers = F.slice(parts, 2, 2**30)
    good = (F.size(parts) >= 6) & (F.get(parts, F.lit(0)) == "cpu") & F.forall(numbers, lambda x: x.rlike(r"^[0-9]+\z"))
    values = F.transform(F.when(good, numbers), lambda x: x.try_cast("bigint"))
    total = F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.when(total.isNotNull(), F.struct((F.get(values, F.lit(3)) + F.get(values, F.lit(4))).alias("idle"), total.alias("total")))


def meminfo_value(content: Column, label: str) -> Column:
    """The last value of a label, or null if a line of it is malformed or there is none."""
    lines = F.filter(F.split(content, "\n"), lambda x: x.startswith(label))
    second = F.transform(lines, lambda x: F.get(fields(x), F.lit(1)))
    good = (F.size(lines) > 0) & F.coalesce(F.forall(second, lambda x: x.rlike(r"^[0-9]+\z")), F.lit(False))
    return F.element_at(F.when(good, second), -1).try_cast("bigint")


def parse_meminfo(content: Column) -> Column:
    """struct(total_kb, available_kb), or null where either is missing or the total is 0."""
    total, available = meminfo_value(content, "MemTotal:"), meminfo_value(content, "MemAvailable:")
    return F.when((total > 0) & available.isNotNull(), F.struct(total.alias("total_kb"), available.alias("available_kb")))


def parse_uptime(content: Column) -> Column:
    first = F.get(F.filter(F.split(content, "[ \n]"), lambda x: x != ""), F.lit(0))
    return F.when(first.rlike(r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?\z"), first).try_cast("double")


def cpu_usage(samples: DataFrame) -> DataFrame:
    """host, ts and usage between each good sample and the good one before it.

    samples: host, ts, content (a cpu line). Malformed lines are passed over; a host's first sample gives no row.
    Counters that stand still or run back give null. An idle step over the total step gives 100, as the
    difference of unsigned counters has it.
    """
    good = samples.withColumn("_cpu", parse_cpu(F.col("content"))).where("_cpu is not null").select("host", "ts", "_cpu.*")
    before = F.lag(F.struct("idle", "total")).over(Window.partitionBy("host").orderBy("ts"))
    pairs = good.withColumn("_b", before).where("_b is not null")
    total, idle = F.col("total") - F.col("_b.total"), F.col("idle") - F.col("_b.idle")
    share = F.lit(100.0) * (total - idle) / F.when(total > 0, total)
    usage = F.when((total <= 0) | (idle < 0), None).when(idle > total, 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), share)))
    return pairs.select("host", "ts", usage.cast("double").alias("usage"))


def host_metrics(snapshots: DataFrame) -> DataFrame:
    """host, ts, name, unit, value of all metrics that can be had; a bad counter costs its own metrics only.

    snapshots: host, ts, stat, meminfo, uptime (texts), disk_total, disk_free (doubles), any of them null. Hosts are
    brought together once; the window that finds the sample before works on that partitioning.
    """
    spread = snapshots.repartition("host")
    line = F.substring_index(F.col("stat"), "\n", 1)
    parsed = spread.select("host", "ts", parse_cpu(line).alias("cpu"), parse_meminfo(F.col("meminfo")).alias("mem"), parse_uptime(F.col("uptime")).alias("up"), "disk_total", "disk_free")
    before = F.last("cpu", ignorenulls=True).over(Window.partitionBy("host").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1))
    total, idle = F.col("cpu.total") - F.col("b.total"), F.col("cpu.idle") - F.col("b.idle")
    share = F.lit(100.0) * (total - idle) / F.when(total > 0, total)
    usage = F.when((total <= 0) | (idle < 0), None).when(idle > total, 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), share)))
    values = {
        "cpu.usage": F.when(F.col("cpu").isNotNull() & F.col("b").isNotNull(), usage),
        "memory.used_percent": used_percent(F.col("mem.total_kb").cast("double"), F.col("mem.available_kb").cast("double")),
        "memory.available_bytes": F.col("mem.available_kb") * 1024.0,
        "disk.used_percent": used_percent(F.col("disk_total"), F.col("disk_free")),
        "disk.free_bytes": F.when(F.col("disk_total").isNotNull(), F.col("disk_free")),
        "host.uptime_seconds": F.col("up"),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(u).alias("unit"), values[n].cast("double").alias("value")) for n, u in HOST_METRICS.items()])
    return parsed.withColumn("b", before).select("host", "ts", F.explode(rows).alias("m")).select("host", "ts", "m.*").where("value is not null")


def parse_proc_snapshots(snapshots: DataFrame, disks: DataFrame | None = None) -> DataFrame:
    """host_metrics' wide input from snapshots as collected: host, ts, kind (stat, meminfo, uptime) and content.

    disks: host, ts, total_bytes and free_bytes. Of several contents of one kind at one time the greatest counts; other
    kinds are passed over.
    """
    kinds = [F.max(F.when(F.col("kind") == k, F.col("content"))).alias(k) for k in ("stat", "meminfo", "uptime")]
    wide = snapshots.groupBy("host", "ts").agg(*kinds)
    if disks is None:
        return wide.withColumn("disk_total", F.lit(None).cast("double")).withColumn("disk_free", F.lit(None).cast("double"))
    d = disks.groupBy("host", "ts").agg(F.max_by(F.struct("total_bytes", "free_bytes"), F.struct("total_bytes", "free_bytes")).alias("_d"))
    return wide.join(d, ["host", "ts"], "full").select("host", "ts", "stat", "meminfo", "uptime", F.col("_d.total_bytes").alias("disk_total"), F.col("_d.free_bytes").alias("disk_free"))


def build_payloads(metrics: DataFrame) -> DataFrame:
    """host, ts and payload: the request of each host and cycle as JSON; one time stamp for all its points, no labels."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    grouped = metrics.groupBy("host", "ts").agg(F.sort_array(F.collect_list(F.struct("name", "unit", "value"))).alias("m"))
    points = F.transform("m", lambda m: F.struct(m["name"].alias("name"), m["unit"].alias("unit"), stamp.alias("ts"), m["value"].alias("value")))
    return grouped.select("host", "ts", F.to_json(F.struct(F.col("host").alias("source"), points.alias("points"))).alias("payload"))
