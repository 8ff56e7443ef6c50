"""Validation of whole requests on their nested points: no explode and no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import limits as lim
from pulsegrid.functions.scalars import filled, name_ok, to_utc, utf16_len


def read_once(p: Column) -> Column:
    """A point with its time and labels as point_reasons takes them: Spark would read them again for each check."""
    entries = F.coalesce(F.map_entries(p["labels"]), F.array().cast("array<struct<key:string,value:string>>"))
    return F.struct(p.alias("p"), to_utc(p["ts"]).alias("ts"), entries.alias("entries"))


def point_reasons(read: Column, received_at: Column) -> Column:
    """All reasons for which a point (of read_once) is bad, as an array; several may hold at once."""
    p, ts, entries = read["p"], read["ts"], read["entries"]
    lengths_ok = F.coalesce(F.forall(entries, lambda e: (utf16_len(e["key"]) <= lim.MAX_LABEL_KEY) & (utf16_len(e["value"]) <= lim.MAX_LABEL_VALUE)), F.lit(False))
    total = F.aggregate(entries, F.lit(0), lambda a, e: a + utf16_len(e["key"]) + F.coalesce(utf16_len(e["value"]), F.lit(0)))
    control = F.exists(entries, lambda e: F.coalesce(e["key"].rlike(r"[\x00-\x1F]") | e["value"].rlike(r"[\x00-\x1F]"), F.lit(False)))
    finite = F.coalesce(~F.isnan(p["value"]) & (F.abs(p["value"]) < float("inf")), F.lit(False))
    checks = {
        "name": ~name_ok(p["name"]),
        "unit": ~filled(p["unit"], lim.MAX_UNIT),
        "value": ~finite,
        "ts": ts.isNull(),
        "ts_future": ts > received_at + F.expr(lim.FUTURE_SKEW),
        "ts_old": ts < received_at - F.expr(lim.MAX_AGE),
        "label_count": F.size(entries) > lim.MAX_LABELS,
        "label_length": ~lengths_ok,
        "label_total": total > lim.MAX_LABEL_TEXT,
        "labels_unstorable": control,
    }
    return F.filter(F.array(*[F.when(bad, F.lit(reason)) for reason, bad in checks.items()]), lambda x: x.isNotNull())


def batch_reasons(source: Column, points: Column) -> Column:
    size = F.coalesce(F.size(points), F.lit(0))
    checks = {"source": ~filled(source, lim.MAX_SOURCE), "batch_empty": size <= 0, "batch_too_large": size > lim.MAX_POINTS}
    return F.filter(F.array(*[F.when(bad, F.lit(reason)) for reason, bad in checks.items()]), lambda x: x.isNotNull())


def with_reasons(requests: DataFrame) -> DataFrame:
    """requests with batch_reasons, and point_reasons: an array of reasons for each point."""
    points = F.coalesce("points", F.array().cast(requests.schema["points"].dataType))
    received = F.col("received_at")
    return requests.withColumn("batch_reasons", batch_reasons(F.col("source"), F.col("points"))).withColumn("point_reasons", F.transform(F.transform(points, read_once), lambda p: point_reasons(p, received)))


def validate_batches(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good requests, rejects): one bad point rejects its whole request; a reject has its first reason."""
    checked = with_reasons(requests)
    reasons = F.concat("batch_reasons", F.flatten("point_reasons"))
    good = checked.where(F.size(reasons) == 0).select(*requests.columns)
    bad = checked.where(F.size(reasons) > 0)
    rejects = bad.select("batch_id", F.lit(None).cast("int").alias("pos"), F.get(reasons, F.lit(0)).alias("reason"), F.greatest(F.size("points"), F.lit(0)).cast("long").alias("n_points"))
    return good, rejects


def validation_errors(requests: DataFrame) -> DataFrame:
    """Every reason of every failing request: batch_id, pos (null: of the request itself), reason, message."""
    checked = with_reasons(requests)
    whole = checked.select("batch_id", F.lit(None).cast("int").alias("pos"), F.explode("batch_reasons").alias("reason"))
    single = checked.select("batch_id", F.posexplode("point_reasons").alias("pos", "reasons")).select("batch_id", "pos", F.explode("reasons").alias("reason"))
    text = F.element_at(F.create_map(*[F.lit(x) for pair in lim.MESSAGES.items() for x in pair]), F.col("reason"))
    return whole.unionByName(single).withColumn("message", text)


def explode_points(requests: DataFrame) -> DataFrame:
    """One row per point, with the request's other columns; ts as an instant."""
    rest = [c for c in requests.columns if c != "points"]
    flat = requests.select(*rest, F.posexplode("points").alias("pos", "p"))
    return flat.select(*rest, "pos", F.col("p.name").alias("name"), F.col("p.unit").alias("unit"), to_utc(F.col("p.ts")).alias("ts"), F.col("p.value").alias("value"), F.col("p.labels").alias("labels"))
