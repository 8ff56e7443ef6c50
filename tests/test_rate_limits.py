"""Limits by rows: repeated and null ids, ties, hot keys over many tasks, and what moves."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import auth, windows
from pulsegrid.operators.auth import limit_cuts, rate_limit

T0 = dt.datetime(2034, 2, 6, 12)
SCHEMA = "row long, batch_id long, key_id long, received_at timestamp"


def table(spark, rows):
    """rows: (batch_id, key_id, seconds)."""
    return spark.createDataFrame([(i, b, k, None if s is None else T0 + dt.timedelta(seconds=s)) for i, (b, k, s) in enumerate(rows)], SCHEMA)


def walked(rows, permit, wide, anchored):
    """Row by row in order of time and id: how many are allowed at each place of each key, and the rows without a limit."""
    out, keys = {}, {k for _, k, s in rows if k is not None}
    for key in keys:
        end, used = None, {}
        for s, b in sorted(((s, b) for b, k, s in rows if k == key and s is not None), key=lambda x: (x[0], x[1] is not None, x[1] or 0)):
            if anchored:
                if end is None or s >= end:
                    end = s + wide
                win = end
            else:
                win = s // wide
            used[win] = used.get(win, 0) + 1
            out[key, s, b] = out.get((key, s, b), 0) + (used[win] <= permit)
    return out


def allowed(result):
    out = {}
    for r in result.collect():
        if r.key_id is None or r.received_at is None:
            assert r.allowed
        else:
            place = (r.key_id, int((r.received_at - T0).total_seconds()), r.batch_id)
            out[place] = out.get(place, 0) + r.allowed
    return out


def test_repeated_and_null_ids(spark):
    """The first and the second come through, whatever their ids."""
    rows = [(1, 5, 0), (2, 5, 1), (1, 5, 2), (None, 5, 3), (None, 5, 4)]
    for mode in ("epoch", "anchored"):
        got = {r.row: r.allowed for r in rate_limit(table(spark, rows), 2, 60, mode).collect()}
        assert got == {0: True, 1: True, 2: False, 3: False, 4: False}


@pytest.mark.parametrize("mode", ["epoch", "anchored"])
@pytest.mark.parametrize("parts", [1, 13])
def test_equals_the_walk(spark, mode, parts):
    rng = random.Random(parts)
    rows = [(rng.choice([None, *range(6)]), rng.choice([None, 1, 1, 1, 2, 3]), rng.choice([None, *range(400), *range(5)])) for _ in range(700)]
    rows += [(7, 4, 100)] * 20
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = rate_limit(table(spark, rows).repartition(parts), 3, 20, mode)
        assert got.columns == ["row", "batch_id", "key_id", "received_at", "allowed"]
        assert allowed(got) == walked(rows, 3, 20, mode == "anchored") and got.count() == len(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_one_key_over_many_tasks(spark):
    """All rows are of one key: stretches of it are walked in many tasks, and start where a single walk would."""
    rng = random.Random(9)
    times = sorted({rng.randrange(10**6) for _ in range(4000)} | set(range(5000, 9000, 7)))
    want, end = [], -1
    for t in times:
        if t >= end:
            want.append(t)
            end = t + 500
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = windows.anchored_starts(spark.createDataFrame([(1, t) for t in times] + [(2, 7)], "key_id long, at long").repartition(3), 500)
        tasks = found.where("key_id = 1").select(F.spark_partition_id().alias("p")).distinct().count()
        assert sorted(r.start for r in found.where("key_id = 1").collect()) == want and tasks > 5
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_maps_of_stretches():
    rng = random.Random(2)
    for _ in range(200):
        at = np.array(sorted({rng.randrange(300) for _ in range(rng.randrange(1, 60))}))
        upto, out = windows.exits(at, 25)
        for entry in [windows.NEVER, *range(-5, 330, 3)]:
            end = entry
            for t in at.tolist():
                if t >= end:
                    end = t + 25
            assert windows.applied(np.array([entry]), upto, out)[0] == end


def test_bodies_do_not_move(spark):
    """With Spark's own broadcasts off, no exchange carries points; the cuts are broadcast as they are few."""
    requests = table(spark, [(i, i % 3, i % 50) for i in range(300)]).withColumn("points", F.array(F.lit("x")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for mode in ("epoch", "anchored"):
            plan = rate_limit(requests, 3, 20, mode)._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_many_cuts_are_joined_otherwise(spark, monkeypatch):
    monkeypatch.setattr(auth, "BROADCAST_CUTS", 2)
    rows = [(i, i % 40, i % 50) for i in range(900)]
    assert allowed(rate_limit(table(spark, rows), 3, 20)) == walked(rows, 3, 20, False)


def test_permits_used_before(spark):
    rows = [(i, 1, i) for i in range(6)] + [(9, 2, 1)]
    win = int(T0.replace(tzinfo=dt.timezone.utc).timestamp()) // 60
    used = spark.createDataFrame([(1, win, 2), (2, win, 50)], "key_id long, win long, used long")
    got = {r.row: r.allowed for r in rate_limit(table(spark, rows), 3, 60, used=used).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False, 4: False, 5: False, 6: False}
    assert not any(r.allowed for r in rate_limit(table(spark, rows), 3, 60, oldest=win + 1).collect())
    assert limit_cuts(table(spark, []), 3, 60).collect() == []
