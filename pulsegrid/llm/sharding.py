"""Uniform shuffling into shards of exact sizes by a hypergeometric communication matrix.

The rows of n partitions go to m boxes, each box a run of slots of one shard. How many rows partition i sends to
box j is drawn exactly as a uniform permutation of all rows would have it. Row i of this matrix is found alone:
partitions form a binary tree, and each node splits the box counts of its subtree between its halves by a
multivariate hypergeometric draw seeded by the node. A task walks one path of the tree, so that no matrix is
held anywhere. Each partition then deals its rows out in random order, and each box permutes what it received.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pulsegrid.llm.common import quoted, tune, write_table

#: Rows that a box holds at most, whatever the number of rows.
BOX_ROWS = 50_000

#: Rows up to which numpy draws hypergeometric numbers itself.
NUMPY_ROWS = 10**9


def boxes(rows: int, shards: int, box_rows: int = BOX_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard, first slot and size of each box; shard sizes differ by one at most, larger ones first."""
    sizes = rows // shards + (np.arange(shards) < rows % shards)
    parts = np.maximum(1, -(-sizes // box_rows))
    shard = np.repeat(np.arange(shards), parts)
    nth = np.arange(len(shard)) - np.repeat(np.cumsum(parts) - parts, parts)
    first, last = (sizes[shard] * nth) // parts[shard], (sizes[shard] * (nth + 1)) // parts[shard]
    return shard, first, last - first


def hypergeometric(good: int, bad: int, draws: int, rng: np.random.Generator) -> int:
    """How many of draws from good and bad rows without return are good, for any number of rows.

    Beyond NUMPY_ROWS the chances are added up outwards from the mode, in doubles; what lies over 14 standard
    deviations away has a chance under 1e-40 and is left out.
    """
    least, most = max(0, draws - bad), min(good, draws)
    if least == most:
        return least
    if good + bad < NUMPY_ROWS:
        return int(rng.hypergeometric(good, bad, draws))
    share = good / (good + bad)
    mode, spread = int(draws * share), math.sqrt(draws * share * (1 - share) * (good + bad - draws) / (good + bad))
    k = np.arange(max(least, mode - int(14 * spread) - 50), min(most, mode + int(14 * spread) + 50) + 1, dtype=np.float64)
    steps = np.log((good - k[:-1]) * (draws - k[:-1])) - np.log((k[:-1] + 1) * (bad - draws + k[:-1] + 1))
    weights = np.r_[0.0, np.cumsum(steps)]
    chance = np.cumsum(np.exp(weights - weights.max()))
    return int(k[min(len(k) - 1, int(np.searchsorted(chance, rng.random() * chance[-1])))])


def hypergeometrics(good: np.ndarray, bad: np.ndarray, draws: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """hypergeometric() for each place of three arrays."""
    out, small = np.zeros_like(good), good + bad < NUMPY_ROWS
    out[small] = rng.hypergeometric(good[small], bad[small], draws[small])
    for i in np.flatnonzero(~small).tolist():
        out[i] = hypergeometric(int(good[i]), int(bad[i]), int(draws[i]), rng)
    return out


def split(total: np.ndarray, left: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each kind are among left draws from total without return.

    Kinds form a binary tree too: each node's draws are split between its halves, all nodes of a level at once.
    """
    levels = [np.r_[total, np.zeros((1 << max(len(total) - 1, 0).bit_length()) - len(total), np.int64)]]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(-1, 2).sum(1))
    drawn = np.array([left], np.int64)
    for sums in levels[-2::-1]:
        first = hypergeometrics(sums[::2], sums[1::2], drawn, rng)
        drawn = np.stack([first, drawn - first], 1).reshape(-1)
    return drawn[: len(total)]


def matrix_row(i: int, counts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """Row i of the communication matrix: what partition i sends to each box."""
    ends, lo, hi, mine = np.r_[0, np.cumsum(counts)], 0, len(counts), sizes.astype(np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = split(mine, int(ends[mid] - ends[lo]), np.random.default_rng([seed, lo, hi]))
        lo, hi, mine = (lo, mid, left) if i < mid else (mid, hi, mine - left)
    return mine


def shard_rows(df: DataFrame, shards: int, seed: int = 0, shard_col: str = "shard", slot_col: str = "slot", box_rows: int = BOX_ROWS) -> DataFrame:
    """df with shard (int, from 0) and slot (long, gapless from 0 in each shard): a uniform shuffle of all rows.

    Shard sizes differ by one at most. All rows count, also repeated ones and those with nulls; columns of the
    output names are replaced, and all other names are free. An empty table gives an empty table; shards may be more than rows. df is written
    once to the shared folder, so that a task that runs again deals its rows out alike. Per partition, one count
    comes to the driver; one exchange moves each row once, box by box, and no box is larger than box_rows.
    """
    spark = df.sparkSession
    tune(spark)
    kept = [f for f in df.schema.fields if f.name not in (shard_col, slot_col)]
    own_names = [f.name for f in kept]
    # numbered, so that no column of df can have the name of one used here
    df = df.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(own_names)])
    kept = [T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(kept)]
    kept_names = [f.name for f in kept]
    table = write_table(df.select(*[quoted(c) for c in kept_names]), "sharding").select("*", F.col("_metadata.file_path").alias("_file"))
    per_file = {r["_file"]: r["n"] for r in table.groupBy("_file").agg(F.count(F.lit(1)).alias("n")).collect()}
    files = sorted(per_file)
    place, counts = {f: i for i, f in enumerate(files)}, np.array([per_file[f] for f in files], np.int64)
    rows = int(counts.sum())
    fields = [T.StructField("_box", T.IntegerType()), T.StructField("_shard", T.IntegerType()), T.StructField("_first", T.LongType())]
    fields += [T.StructField("_order", T.LongType()), T.StructField("_from", T.LongType())]
    added = [f.name for f in fields]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[str, list] = {}
        # from three numbers, so that tasks are not sent a list of all boxes
        shard, first, sizes = boxes(rows, shards, box_rows)
        for batch in batches:
            box, order = np.empty(batch.num_rows, np.int32), np.empty(batch.num_rows, np.int64)
            origin = np.empty(batch.num_rows, np.int64)
            names_of = batch.column("_file").dictionary_encode()
            for k, name in enumerate(names_of.dictionary.to_pylist()):
                at = np.flatnonzero(names_of.indices.to_numpy() == k)
                start = batch.column("_row").take(pa.array(at)).to_numpy()
                if name not in state:
                    i = place[name]
                    rng = np.random.default_rng([seed, 1, i])
                    to = rng.permutation(np.repeat(np.arange(len(sizes), dtype=np.int32), matrix_row(i, counts, sizes, seed)))
                    state[name] = [i, to, rng.integers(-(2**62), 2**62, len(to))]
                i, to, keys = state[name]
                box[at], order[at], origin[at] = to[start], keys[start], (i << 40) + start
            new = [pa.array(x) for x in (box, shard[box].astype(np.int32), first[box], order, origin)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept_names] + new, names=kept_names + added)

    dealt = table.select(*[quoted(c) for c in kept_names], "_file", F.col("_metadata.row_index").alias("_row")).mapInArrow(deal, T.StructType(kept + fields))
    inside = Window.partitionBy("_box").orderBy("_order", "_from")
    slot = F.col("_first") + F.row_number().over(inside) - 1
    return dealt.select(*[F.col(c).alias(name) for c, name in zip(kept_names, own_names)], F.col("_shard").alias(shard_col), slot.alias(slot_col))
