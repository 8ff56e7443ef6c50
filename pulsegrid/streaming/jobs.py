"""Structured Streaming jobs: continuous ingest, stateful rate limits and CPU use, deduplication."""

from __future__ import annotations

import json
import logging
import threading
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulsegrid.functions.limits import RATE_PERMIT, RATE_WINDOW_SECONDS
from pulsegrid.operators.host import parse_cpu
from pulsegrid.plans.store import KEEP_WINDOWS, ingest_epoch
from pulsegrid.plans.ingest import STATUS_REASONS
from pulsegrid.plans.rollups import roll_in
from pulsegrid.sources.log import Conflict, read_json

log = logging.getLogger(__name__)

#: Why points are lost beside a request's status.
FLUSH_FAILURE = "flush_failure"
REASONS = [*STATUS_REASONS.values(), "unknown_source", "no_partition", FLUSH_FAILURE]


def ingest_stream(requests: DataFrame, dims: Callable[[], dict[str, DataFrame]], path: str, checkpoint: str, permit: int = RATE_PERMIT, window_seconds: int = RATE_WINDOW_SECONDS, trigger: dict | None = None, keep_windows: int = KEEP_WINDOWS, pass_over: bool = False):
    """Starts the ingest of a stream of requests into the tables under path; each micro-batch is an epoch of ingest_epoch.

    dims() gives api_keys, sources and weeks afresh for every micro-batch. Limits, series and last_seen carry on from
    epoch to epoch; one that is tried again after a failure takes the place of what it committed before, if it did. The
    stream is known by the id in its checkpoint, so that a new checkpoint adds epochs and replaces none. How much a
    micro-batch takes is limited where the stream is read (request_stream). Late data are judged by their time of
    arrival, not by a watermark.

    pass_over: a micro-batch whose points cannot be written is not tried for ever. It is committed without them, with a
    row of losses and rejects of the reason flush_failure, and the stream goes on. What fails then too ends the stream,
    and so does another writer's commit.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        stream = read_json(batch.sparkSession, f"{checkpoint}/metadata")["id"]
        how = (path, epoch, permit, window_seconds, keep_windows, stream)
        try:
            ingest_epoch(batch, dims(), *how)
        except Conflict:
            raise
        except Exception as error:
            if not pass_over:
                raise
            log.warning("epoch %s of stream %s is passed over: %s", epoch, stream, error)
            ingest_epoch(batch, dims(), *how, lost_as=FLUSH_FAILURE)

    return requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def rate_limit_stream(requests: DataFrame, permit: int = RATE_PERMIT, window_seconds: int = RATE_WINDOW_SECONDS, keep_windows: int = KEEP_WINDOWS) -> DataFrame:
    """key_id, batch_id, received_at, allowed and reason of a stream of requests; the permits used in a key's latest windows are its state.

    Within a micro-batch requests count in order of arrival; over micro-batches in the order in which they come. Every
    request gets a verdict: one of a window more than keep_windows behind its key's latest is refused as late. A key's
    state is a few numbers for each kept window with requests, and stays, as keys do.
    """
    wide = window_seconds * 1_000_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = {int(w): n for w, n in json.loads(state.get[0]).items()} if state.exists else {}
        # a key's rows of one micro-batch, which the stream's admission limit bounds
        rows = pd.concat(list(frames)).sort_values(["at", "batch_id"], kind="stable")
        window = rows["at"] // wide
        late = window < max(used, default=int(window.min())) - keep_windows
        over = rows.groupby(window).cumcount() + 1 + window.map(used).fillna(0).astype("int64") > permit
        for w, n in window.value_counts().items():
            used[int(w)] = used.get(int(w), 0) + int(n)
        reason = ["late" if x else "rate_limited" if y else None for x, y in zip(late, over)]
        yield pd.DataFrame({"key_id": rows["key_id"], "batch_id": rows["batch_id"], "received_at": rows["received_at"], "allowed": ~(late | over), "reason": pd.Series(reason, rows.index, dtype=object)})
        newest = max(used, default=0)
        state.update((json.dumps({w: n for w, n in used.items() if w >= newest - keep_windows}),))

    narrow = requests.select("key_id", "batch_id", "received_at", F.unix_micros("received_at").alias("at"))
    return narrow.groupBy("key_id").applyInPandasWithState(step, "key_id long, batch_id long, received_at timestamp, allowed boolean, reason string", "used string", "append", GroupStateTimeout.NoTimeout)


def cpu_usage_stream(samples: DataFrame, silence: str = "1 day") -> DataFrame:
    """host, ts and usage of a stream of samples (host, ts, content); the last good sample is the state of its host.

    The rules are those of the batch form; samples of a host come in order of time, and one that is not later than
    the state is passed over.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        at = rows["ts"].astype("datetime64[us]").astype("int64")
        held = state.get if state.exists else None
        out = []
        for ts, t, idle, total in zip(rows["ts"], at, rows["idle"], rows["total"]):
            if held is not None and t <= held[0]:
                continue
            if held is not None:
                di, dt = idle - held[1], total - held[2]
                use = None if dt <= 0 or di < 0 else 100.0 if di > dt else min(100.0, max(0.0, 100.0 * (dt - di) / dt))
                out.append((key[0], ts, use))
            held = (int(t), int(idle), int(total))
        if held is not None:
            state.update(held)
            state.setTimeoutTimestamp(max(held[0] // 1000, state.getCurrentWatermarkMs()) + 86_400_000)
        yield pd.DataFrame(out, columns=["host", "ts", "usage"])

    good = samples.withWatermark("ts", silence).withColumn("c", parse_cpu(F.col("content"))).where("c is not null").select("host", "ts", "c.idle", "c.total")
    return good.groupBy("host").applyInPandasWithState(step, "host string, ts timestamp, usage double", "at long, idle long, total long", "append", GroupStateTimeout.EventTimeTimeout)


def dedupe_stream(points: DataFrame, delay: str = "7 days") -> DataFrame:
    """Points (series_id, ts, value) once each, as far as the watermark reaches (an extension: by default duplicates stay)."""
    return points.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["series_id", "ts", "value"])


def losses_stream(rejects: DataFrame, name: str = "losses") -> DataFrame:
    """Rejects that report their lost points, all and by reason, to a listener (LossCounter) or to the query's progress."""
    by_reason = [F.sum(F.when((F.col("reason") == r) & (F.col("n_points") > 0), F.col("n_points"))).alias(r) for r in REASONS]
    return rejects.observe(name, F.sum("n_points").alias("points"), F.count(F.lit(1)).alias("rejects"), *by_reason)


class LossCounter(StreamingQueryListener):
    """Adds up the lost points by reason that streams of losses_stream report; reasons without any are left out.

    It hears of each micro-batch once, a little after it ended; ended is set when a query has.
    """

    def __init__(self, name: str = "losses") -> None:
        self.name, self.points, self.ended = name, Counter(), threading.Event()

    def onQueryStarted(self, event) -> None:
        self.ended.clear()

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.points.update({r: row[r] for r in REASONS if row[r]})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()


def rollup_1m_stream(points: DataFrame, delay: str = "7 days") -> DataFrame:
    """Minutes of a stream of points, each when the watermark has passed it (an extension)."""
    g = points.withWatermark("ts", delay).groupBy("series_id", F.window("ts", "1 minute").alias("w"))
    out = g.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"), F.max_by("value", F.struct("ts", "value")).alias("last"))
    return out.select("series_id", F.col("w.start").alias("bucket"), "n", "total", "least", "most", "last")


def rollup_1h_stream(points: DataFrame, delay: str = "7 days") -> DataFrame:
    """Hours of a stream of points, added up from its minutes in the same stream, each when the watermark has passed it (an extension)."""
    g = points.withWatermark("ts", delay).groupBy("series_id", F.window("ts", "1 minute").alias("w"))
    minutes = g.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"), F.max_by("value", F.struct("ts", "value")).alias("last"))
    hours = minutes.groupBy("series_id", F.window("w", "1 hour").alias("h")).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"), F.max_by("last", F.col("w.start")).alias("last")
    )
    out = hours.select("series_id", F.col("h.start").alias("bucket"), "n", "total", "least", "most", "last")
    return out.withColumn("mean", F.col("total") / F.col("n"))


def rollup_stream(points: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Starts a stream of points into the table under path and its rollups at rest; late points are rolled up whenever they come."""

    def run(batch: DataFrame, epoch: int) -> None:
        roll_in(batch, path, read_json(batch.sparkSession, f"{checkpoint}/metadata")["id"], epoch)

    return points.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 minute"})).start()
