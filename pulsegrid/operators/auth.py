"""Authentication, authorisation, rate limits and the status of each request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.functions.limits import RATE_PERMIT, RATE_WINDOW_SECONDS
from pulsegrid.functions.scalars import key_hash, scope_name, scope_satisfies
from pulsegrid.operators.validate import with_reasons
from pulsegrid.operators.windows import anchored_starts, in_windows
from pulsegrid.sources.scratch import written


def authenticate(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """requests with key_id, tenant_id and scope of the key that lived when they came in; null if there was none.

    Keys are unique by hash; the join is left to Spark, which broadcasts keys only by their measured size.
    """
    k = keys.select(F.col("id").alias("key_id"), "tenant_id", scope_name(F.col("scope")).alias("scope"), F.col("key_hash").alias("_hash"), F.col("created_at").alias("_from"), F.col("revoked_at").alias("_to"))
    lived = (F.col("_from").isNull() | (F.col("_from") <= F.col("received_at"))) & (F.col("_to").isNull() | (F.col("received_at") < F.col("_to")))
    base = requests.drop("key_id", "tenant_id", "scope").withColumn("_h", key_hash(F.col("api_key")))
    return base.join(k, (F.col("_h") == F.col("_hash")) & lived, "left").drop("_h", "_hash", "_from", "_to")


def limit_window(window_seconds: int) -> Column:
    """The number of the window that a request comes in: windows lie on multiples of their length."""
    return F.floor(F.unix_micros("received_at") / (window_seconds * 1_000_000)).cast("long")


def permits_used(requests: DataFrame, window_seconds: int = RATE_WINDOW_SECONDS) -> DataFrame:
    """key_id, win and used: requests by key and window."""
    return requests.where("key_id is not null").groupBy("key_id", limit_window(window_seconds).alias("win")).agg(F.count(F.lit(1)).alias("used"))


#: Rows of limit_cuts up to which they are broadcast whatever Spark's own threshold: some 40 bytes each.
BROADCAST_CUTS = 200_000


def limit_cuts(requests: DataFrame, permit: int = RATE_PERMIT, window_seconds: int = RATE_WINDOW_SECONDS, mode: str = "epoch", used: DataFrame | None = None) -> DataFrame:
    """Where the windows that are over their limit are cut: key_id, bin, start, end, cut and free.

    Requests come in order of (received_at, batch_id), nulls first. cut is the place in it (micros, batch_id) at which
    permits run out: requests before it have one, those after it none, and so many as free of those at that very place.
    bin is a number of a window's length that the window touches: a window on multiples of its length touches one,
    another one touches two, and has a row for each.

    Counts by key and window come first, so that only requests of windows over the limit are ranked, by their times and
    ids alone; those are written once for both. used (key_id, win, used; mode "epoch") counts what came before.
    """
    if mode not in ("epoch", "anchored"):
        raise ValueError(f"unknown mode {mode!r}")
    wide = window_seconds * 1_000_000
    narrow = written(requests.where("key_id is not null and received_at is not null").select("key_id", F.unix_micros("received_at").alias("at"), "batch_id"), "arrivals")
    if mode == "epoch":
        win = F.floor(F.col("at") / wide).cast("long")
        counts = narrow.groupBy("key_id", win.alias("win")).agg(F.count(F.lit(1)).alias("n"))
        before = F.lit(0).cast("long")
        if used is not None:
            counts, before = counts.join(used.select("key_id", "win", "used"), ["key_id", "win"], "left"), F.coalesce("used", F.lit(0)).cast("long")
        over = counts.where(F.col("n") + before > permit).select("key_id", "win", before.alias("before"))
        placed = narrow.withColumn("win", win).join(over, ["key_id", "win"]).withColumn("start", F.col("win") * wide)
    else:
        inside = in_windows(narrow, anchored_starts(narrow, wide), wide)
        over = inside.groupBy("key_id", "start").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > permit)
        placed = inside.join(over.select("key_id", "start", F.lit(0).cast("long").alias("before")), ["key_id", "start"])
    by = ["key_id", "start", "before"]
    alike = placed.groupBy(*by, "at", "batch_id").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("key_id", "start").orderBy("at", "batch_id")
    upto = alike.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("before"))
    last = upto.where(F.col("upto") > permit).groupBy("key_id", "start").agg(F.min_by(F.struct("at", "batch_id", "n", "upto"), "upto").alias("x"))
    # the place where the limit is passed: those before it have a permit, and so many at it
    free = F.col("x.n") - (F.col("x.upto") - permit)
    cut = F.struct(F.col("x.at").alias("at"), F.col("x.batch_id").alias("batch_id"))
    found = last.select("key_id", "start", (F.col("start") + wide).alias("end"), cut.alias("cut"), F.greatest(free, F.lit(0)).alias("free"))
    bins = F.array_distinct(F.array(F.floor(F.col("start") / wide), F.floor((F.col("end") - 1) / wide)))
    return found.select("key_id", F.explode(bins).alias("bin"), "start", "end", "cut", "free")


def with_verdict(requests: DataFrame, cuts: DataFrame, window_seconds: int, oldest: int | None = None) -> DataFrame:
    """requests with allowed, by the cuts of their keys' windows; those of windows before oldest are refused.

    Bodies stay where they are: the cuts, one or two rows for each window over its limit, are written, counted, and
    broadcast while they are at most BROADCAST_CUTS; beyond that they are joined as Spark sees fit. Only requests at
    the very place of a cut, where some are free and some are not, are numbered among each other.
    """
    wide = window_seconds * 1_000_000
    known = written(cuts, "cuts")
    size, tied = known.agg(F.count(F.lit(1)), F.max(F.col("free") > 0)).first()
    c = known.select(F.col("key_id").alias("_key"), F.col("bin").alias("_bin"), F.col("start").alias("_start"), F.col("end").alias("_end"), F.col("cut").alias("_cut"), F.col("free").alias("_free"))
    at = F.unix_micros("received_at")
    where = (F.col("key_id") == F.col("_key")) & (F.floor(at / wide).cast("long") == F.col("_bin")) & (at >= F.col("_start")) & (at < F.col("_end"))
    joined = requests.join(F.broadcast(c) if size <= BROADCAST_CUTS else c, where, "left")
    place = F.struct(at.alias("at"), F.col("batch_id").alias("batch_id"))
    late = F.lit(False) if oldest is None else F.col("key_id").isNotNull() & (F.floor(at / wide) < oldest)
    free = F.lit(False)
    if tied:
        at_cut = F.col("_cut").isNotNull() & (place == F.col("_cut")) & (F.col("_free") > 0)
        inside = joined.where(at_cut).withColumn("_nth", F.row_number().over(Window.partitionBy("key_id", "received_at", "batch_id").orderBy(F.lit(1))))
        joined = inside.unionByName(joined.where(F.coalesce(~at_cut, F.lit(True))).withColumn("_nth", F.lit(0)))
        free = (F.col("_nth") > 0) & (F.col("_nth") <= F.col("_free"))
    allowed = (F.col("_key").isNull() | F.coalesce(place < F.col("_cut"), F.lit(False)) | free) & ~late
    return joined.withColumn("allowed", allowed).drop("_key", "_bin", "_start", "_end", "_cut", "_free", "_nth")


def rate_limit(requests: DataFrame, permit: int = RATE_PERMIT, window_seconds: int = RATE_WINDOW_SECONDS, mode: str = "epoch", used: DataFrame | None = None, oldest: int | None = None) -> DataFrame:
    """requests with allowed: at most permit per key and window, in order of arrival.

    Every row is a request of its own, also where ids are null or come again. mode "epoch": windows lie on multiples of
    their length, so a hot key is spread over its windows. mode "anchored": a key's window starts at its first request,
    the next at the first request after its end. Requests without a key or a time are not limited.
    """
    return with_verdict(requests, limit_cuts(requests, permit, window_seconds, mode, used), window_seconds, oldest)


def entitled_requests(known: DataFrame, required: str = "ingest") -> DataFrame:
    """Of authenticated requests those whose scope satisfies: only they count against a key's limit."""
    return known.where(scope_satisfies(F.col("scope"), F.lit(required)))


def ingest_status(requests: DataFrame, keys: DataFrame, permit: int = RATE_PERMIT, window_seconds: int = RATE_WINDOW_SECONDS, required: str = "ingest", used: DataFrame | None = None, oldest: int | None = None) -> DataFrame:
    """requests with tenant_id, key_id, the one status each gets, in this order: 401, 403, 429, 400, 202; and accepted, the points of a 202.

    used and oldest: as over_limit takes them.
    """
    known = authenticate(requests, keys)
    entitled = scope_satisfies(F.col("scope"), F.lit(required))
    counted = entitled_requests(known.select("batch_id", "key_id", "received_at", "scope"), required)
    # a request that is not entitled counts for nothing, and its verdict is not used
    limited = with_verdict(known, limit_cuts(counted, permit, window_seconds, "epoch", used), window_seconds, oldest)
    checked = with_reasons(limited)
    bad = F.size(F.concat("batch_reasons", F.flatten("point_reasons"))) > 0
    status = F.when(F.col("key_id").isNull(), 401).when(~entitled, 403).when(~F.col("allowed"), 429).when(bad, 400).otherwise(202)
    out = checked.withColumn("status", status).drop("batch_reasons", "point_reasons", "allowed")
    return out.withColumn("accepted", F.when(F.col("status") == 202, F.size("points").cast("long")).otherwise(F.lit(0).cast("long")))


def ingest_funnel(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("tenant_id", "status").agg(F.count(F.lit(1)).alias("requests"), F.sum("accepted").alias("accepted"))


