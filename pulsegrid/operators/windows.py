"""Windows that start at a key's first request, and again at the first request after their end, over any number of tasks.

Where a window starts depends on all windows of its key before it. A stretch of a key's requests, in order of time, does
not need them to tell what it does to them: it maps the end of the window that is open on entry to the end of the one
that is open on exit, a step function. Requests are range-partitioned by key and time, so that only keys at the borders
of partitions are in several. Their stretches' maps are composed two by two, then four by four, and so on, which gives
each stretch its entry in as many rounds as the logarithm of their number. With it every stretch is walked by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.sources.scratch import written

#: No window is open.
NEVER = -(2**63)


def exits(at: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """The map of a stretch with sorted times at, as (upto, exit): an entry of upto at most, and over the one before, gives exit.

    Entries over the last upto stay as they are: no request of the stretch is beyond them.
    """
    following = np.searchsorted(at, at + wide)
    last = np.where(following < len(at), following, np.arange(len(at)))
    while True:
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    out = at[last] + wide
    end = np.r_[out[1:] != out[:-1], True]
    return at[end], out[end]


def applied(entries: np.ndarray, upto: np.ndarray, out: np.ndarray) -> np.ndarray:
    """What a map makes of entries."""
    i = np.searchsorted(upto, entries)
    return np.where(i < len(upto), out[np.minimum(i, len(upto) - 1)], entries)


def anchored_starts(requests: DataFrame, wide: int) -> DataFrame:
    """key_id and start of all windows of requests (key_id, at in micros); wide: their length in micros."""
    times = requests.select("key_id", "at").distinct()
    placed = written(times.repartitionByRange("key_id", "at").withColumn("chunk", F.spark_partition_id()), "times")
    across = placed.groupBy("key_id").agg(F.min("chunk").alias("first"), F.max("chunk").alias("last")).where("first < last")
    key = dict(placed.dtypes)["key_id"]
    given = placed.join(entries_of(placed, written(across, "across"), wide, key), ["key_id", "chunk"], "left")
    ordered = given.select("key_id", "chunk", "at", F.coalesce("entry", F.lit(NEVER)).alias("entry")).repartition("key_id", "chunk").sortWithinPartitions("key_id", "chunk", "at")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A batch at a time; what is carried on is one stretch and its window's end."""
        current, end = None, NEVER
        for batch in batches:
            keys, chunks, at, entry = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cut = np.flatnonzero((keys[1:] != keys[:-1]) | (chunks[1:] != chunks[:-1])) + 1
            starts = []
            for lo, hi in zip(np.r_[0, cut].tolist(), np.r_[cut, len(keys)].tolist()):
                if lo == hi:
                    continue
                if (keys[lo], chunks[lo]) != current:
                    current, end = (keys[lo], chunks[lo]), int(entry[lo])
                while (lo := lo + int(np.searchsorted(at[lo:hi], end))) < hi:
                    starts.append(lo)
                    end = int(at[lo]) + wide
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(starts, pa.int64())), batch.column(2).take(pa.array(starts, pa.int64()))], names=["key_id", "start"])

    return ordered.mapInArrow(walk, f"key_id {key}, start long")


def entries_of(placed: DataFrame, across: DataFrame, wide: int, key: str) -> DataFrame:
    """key_id, chunk and entry of the stretches of keys in several partitions (across: key_id, first, last)."""
    widest = across.agg(F.max(F.col("last") - F.col("first"))).first()[0] or 0
    mine = placed.join(F.broadcast(across), "key_id").withColumn("nth", F.col("chunk") - F.col("first"))
    schema = f"key_id {key}, nth int, upto long, exit long"

    def mapped(rows: pd.DataFrame) -> pd.DataFrame:
        upto, out = exits(np.sort(rows["at"].to_numpy()), wide)
        return pd.DataFrame({"key_id": rows["key_id"].iloc[0], "nth": rows["nth"].iloc[0], "upto": upto, "exit": out})

    def composed(first: pd.DataFrame, second: pd.DataFrame) -> pd.DataFrame:
        """The two maps one after the other; entries that the first lets through meet the second as they are. No rows: all stays as it is."""
        if not len(first):
            return second[["key_id", "nth", "upto", "exit"]]
        if len(second):
            second = second.sort_values("upto")
            through = second[second["upto"] > first["upto"].max()]
            first = first.assign(exit=applied(first["exit"].to_numpy(), second["upto"].to_numpy(), second["exit"].to_numpy()))
            first = pd.concat([first, through.assign(nth=first["nth"].iloc[0])])
        return first[["key_id", "nth", "upto", "exit"]]

    def entered(known: pd.DataFrame, maps: pd.DataFrame) -> pd.DataFrame:
        if not len(known):
            return known.assign(entry=pd.Series(dtype="int64"))[["key_id", "nth", "entry"]]
        if not len(maps):
            return known[["key_id", "nth", "entry"]]
        maps = maps.sort_values("upto")
        return known.assign(entry=applied(known["entry"].to_numpy(), maps["upto"].to_numpy(), maps["exit"].to_numpy()))[["key_id", "nth", "entry"]]

    maps = written(mine.groupBy("key_id", "nth").applyInPandas(mapped, schema), "maps")
    known = across.select("key_id", F.lit(0).alias("nth"), F.lit(NEVER).alias("entry"))
    step = 1
    while step <= widest:
        # entries of the first stretches give those of as many more behind them
        reached = known.groupBy("key_id", "nth").cogroup(maps.groupBy("key_id", "nth")).applyInPandas(entered, f"key_id {key}, nth int, entry long")
        known = written(known.unionByName(reached.withColumn("nth", F.col("nth") + step)), "entries")
        if 2 * step <= widest:
            after = maps.withColumn("nth", F.col("nth") - step).where("nth >= 0")
            maps = written(maps.groupBy("key_id", "nth").cogroup(after.groupBy("key_id", "nth")).applyInPandas(composed, schema), "maps")
        step *= 2
    found = known.join(across, "key_id").where(F.col("nth") <= F.col("last") - F.col("first"))
    return found.select("key_id", (F.col("first") + F.col("nth")).alias("chunk"), "entry")


def in_windows(requests: DataFrame, starts: DataFrame, wide: int) -> DataFrame:
    """requests (key_id, at) with the start of their window. Windows of a key lie apart, so each touches two numbers of its length at most: an equality join."""
    bins = F.array_distinct(F.array(F.floor(F.col("start") / wide), F.floor((F.col("start") + wide - 1) / wide)))
    s = starts.select(F.col("key_id").alias("_key"), "start", F.explode(bins).alias("_bin"))
    same = (F.col("key_id") == F.col("_key")) & (F.floor(F.col("at") / wide) == F.col("_bin")) & (F.col("at") >= F.col("start")) & (F.col("at") < F.col("start") + wide)
    return requests.join(s, same).drop("_key", "_bin")
