"""From request logs to points: the whole batch path, each stage with its rejects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.limits import RATE_PERMIT, RATE_WINDOW_SECONDS
from pulsegrid.operators.auth import ingest_status
from pulsegrid.operators.points import split_covered
from pulsegrid.operators.resolve import new_series, resolve_series, resolve_sources, with_canonical
from pulsegrid.operators.validate import explode_points

#: What a status other than 202 rejects a request for.
STATUS_REASONS = {401: "unauthorized", 403: "forbidden", 429: "rate_limited", 400: "invalid"}


@dataclass
class Ingested:
    """accepted: requests with source_id; points: resolvable points with canonical labels; rejects: batch_id, pos, reason, n_points."""

    statuses: DataFrame
    accepted: DataFrame
    points: DataFrame
    rejects: DataFrame


def n_points() -> Column:
    return F.greatest(F.coalesce(F.size("points"), F.lit(0)), F.lit(0)).cast("long").alias("n_points")


def slim(statuses: DataFrame) -> DataFrame:
    """Statuses as they are kept for what follows: of the points of refused requests only their number stays."""
    points = F.when(F.col("status") == 202, F.col("points")).alias("points")
    return statuses.select("batch_id", "received_at", "key_id", "tenant_id", "scope", "source", "status", n_points(), points)


def rejects_of(batches: DataFrame, reason) -> DataFrame:
    size = F.col("n_points") if "n_points" in batches.columns else n_points()
    return batches.select("batch_id", F.lit(None).cast("int").alias("pos"), reason.alias("reason"), size)


def ingest(requests: DataFrame, keys: DataFrame, sources: DataFrame, permit: int = RATE_PERMIT, window_seconds: int = RATE_WINDOW_SECONDS, used: DataFrame | None = None, oldest: int | None = None) -> Ingested:
    """The tenant of a request is that of its key. Only whole requests are accepted or rejected. used, oldest: as in over_limit."""
    return ingested(ingest_status(requests, keys, permit, window_seconds, used=used, oldest=oldest), sources)


def ingested(statuses: DataFrame, sources: DataFrame) -> Ingested:
    """What follows from the requests' statuses; statuses are used several times, so they should be kept."""
    reason = F.lit(None).cast("string")
    for status, text in STATUS_REASONS.items():
        reason = F.when(F.col("status") == status, text).otherwise(reason)
    refused = rejects_of(statuses.where("status <> 202"), reason)
    accepted, unknown = resolve_sources(statuses.where("status = 202"), sources)
    points = with_canonical(explode_points(accepted.select("batch_id", "received_at", "tenant_id", "source_id", "points")))
    return Ingested(statuses, accepted, points, refused.unionByName(rejects_of(unknown, F.lit("unknown_source"))))


def resolved_points(ingested: Ingested, series: DataFrame, weeks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points with series_id in weeks that exist, rejects of the others, new series without ids), against a dimension that holds them."""
    fresh = new_series(ingested.points, series)
    covered, uncovered = (resolve_series(found, series) for found in split_covered(ingested.points, weeks))
    lost = uncovered.select("batch_id", "pos", F.lit("no_partition").alias("reason"), F.lit(1).cast("long").alias("n_points"))
    return covered, lost, fresh
