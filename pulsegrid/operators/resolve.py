"""Sources and series: resolving, discovering and numbering them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.functions.scalars import canonical_labels
from pulsegrid.sources.scratch import written

SERIES_KEY = ["tenant_id", "source_id", "name", "canonical"]


def resolve_sources(batches: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(batches with source_id, batches of sources nobody registered); by tenant and name, before any explode."""
    s = sources.select(F.col("id").alias("source_id"), "tenant_id", F.col("name").alias("source"))
    joined = batches.drop("source_id").join(s, ["tenant_id", "source"], "left")
    return joined.where("source_id is not null"), joined.where("source_id is null").drop("source_id")


def unknown_sources(unresolved: DataFrame) -> DataFrame:
    """Discarded batches and points by tenant and source."""
    return unresolved.groupBy("tenant_id", "source").agg(F.count(F.lit(1)).alias("batches"), F.sum(F.size("points").cast("long")).alias("points"))


def with_canonical(points: DataFrame) -> DataFrame:
    return points.withColumn("canonical", canonical_labels(F.col("labels")))


def series_seen(points: DataFrame) -> DataFrame:
    """One row per series of points (with canonical): the unit of its first writer, and when that came in.

    Units are no part of the identity: the first by (received_at, batch_id, pos) stays. min_by adds up before the
    shuffle, so a hot series sends one row per task.
    """
    first = F.struct("received_at", "batch_id", "pos")
    return points.groupBy(*SERIES_KEY).agg(F.min_by("unit", first).alias("unit"), F.min("received_at").alias("created_at"))


def new_series(points: DataFrame, series: DataFrame) -> DataFrame:
    """Series of points that the dimension lacks."""
    return series_seen(points).join(series.select("tenant_id", "source_id", "name", F.col("labels").alias("canonical")), SERIES_KEY, "left_anti")


def assign_ids(rows: DataFrame, order: list[str], first_id: int, id_col: str = "id") -> DataFrame:
    """rows with ids first_id, first_id + 1, ... in the given order, without one task that holds them all.

    Rows are range-partitioned and sorted by the order; the counts of the partitions, one number each, give every
    partition its offset.
    """
    part = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = sorted((r["_part"], r["count"]) for r in part.groupBy("_part").count().collect())
    offsets, total = [], first_id
    for p, n in counts:
        offsets.append((p, total))
        total += n
    table = rows.sparkSession.createDataFrame(offsets, "_part int, _offset long")
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return part.join(F.broadcast(table), "_part").withColumn(id_col, (F.col("_offset") + nth).cast("int")).drop("_part", "_offset")


def numbered_series(points: DataFrame, series: DataFrame) -> DataFrame:
    """The series of points that the dimension lacks, with ids that follow its own, in the dimension's columns."""
    last = series.agg(F.max("id")).first()[0] or 0
    added = assign_ids(new_series(points, series), SERIES_KEY, last + 1)
    return added.withColumnRenamed("canonical", "labels").select(*[c for c in series.columns if c != "epoch"])


def upsert_series(points: DataFrame, series: DataFrame) -> DataFrame:
    """The dimension with the new series of points added; a second run adds none. Existing rows stay as they are."""
    return series.unionByName(numbered_series(points, series))


def resolve_series(points: DataFrame, series: DataFrame) -> DataFrame:
    """points (with canonical) with series_id; Spark broadcasts the dimension only by its measured size."""
    s = series.select(F.col("id").alias("series_id"), "tenant_id", "source_id", "name", F.col("labels").alias("canonical"))
    return points.join(s, SERIES_KEY)


def unit_conflicts(points: DataFrame) -> DataFrame:
    """Series whose writers disagree on the unit: the one that stays, and how many there were."""
    first = F.struct("received_at", "batch_id", "pos")
    g = points.groupBy(*SERIES_KEY).agg(F.min_by("unit", first).alias("unit"), F.count_distinct("unit").alias("units"))
    return g.where("units > 1")


def series_cardinality(series: DataFrame) -> DataFrame:
    return series.groupBy("tenant_id", "source_id", "name").agg(F.count(F.lit(1)).alias("series"))


def top_cardinality(series: DataFrame, k: int = 10) -> DataFrame:
    """The k (tenant, source, name) with the most series; ties by key."""
    return series_cardinality(series).orderBy(F.desc("series"), "tenant_id", "source_id", "name").limit(k)


def approx_cardinality(points: DataFrame) -> DataFrame:
    """Distinct label sets per tenant and name straight from points, by a sketch."""
    return points.groupBy("tenant_id", "name").agg(F.approx_count_distinct(F.struct("source_id", "canonical")).alias("series"))


#: Registers of a sketch: 2**12, so that one standard error is 1.04 / 64.
SKETCH_LOG = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_LOG / 2)


def cardinality_sketches(points: DataFrame) -> DataFrame:
    """tenant_id, name, day and sketch of the series of points (with canonical): small, and to be put together over any span of days."""
    series = F.concat_ws("\x1f", F.col("source_id").cast("string"), "canonical")
    return points.groupBy("tenant_id", "name", F.to_date("ts").alias("day")).agg(F.hll_sketch_agg(series, F.lit(SKETCH_LOG)).alias("sketch"))


def cardinality_between(sketches: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """tenant_id, name and series: an estimate of how many there were from first to last, without their points."""
    inside = sketches.where((F.col("day") >= F.lit(first)) & (F.col("day") <= F.lit(last)))
    return inside.groupBy("tenant_id", "name").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("series"))
