"""Exact top-k inner products, pruned by multi-resolution segment statistics.

A vector cut into segments has in each a mean and a standard deviation. For a segment of length l the inner
product is at most l * (mean * mean' + deviation * deviation'), so their sum bounds the score from above, and
the matching bound on the distance from below. Bounds with few segments come first, finer ones only for pairs
that may still reach a query's k-th best score, and exact integer products only for what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.llm.common import Fields, batch_of, ddl, quoted, write_table

#: Vectors in a tile, vectors that meet a block of queries in one task, and queries in a block, on average.
TILE, GROUP, BLOCK = 2048, 8192, 2048
#: Segments at each resolution, coarse to fine: the finest has two components of 64 in each.
LEVELS = (1, 4, 16, 32)
#: Where the pairs of a tile that are left are parted, by the place of their bound among a query's: the best are multiplied first, in multiples of k, and raise its floor for the others.
FIRST = (4, 16, 64)
#: Shares of pairs left, above which a level is computed for all pairs at once.
DENSE = 0.15
LONG = (-(2**63), 2**63 - 1)

L, B, S = pa.int64(), pa.binary(), pa.string()
TILES: Fields = {"tile": L, "dim": pa.int32(), "queries": L, "ids": B, "query": B, "kind": S, "data": B}
BLOCKS: Fields = {"dim": pa.int32(), "block": L, "ids": B, "places": B, "kind": S, "data": B}
FOUND: Fields = dict.fromkeys(["query_tile", "query_row", "query_id", "vec_id", "score", "tile", "row"], L)


def pack(values: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers in the smallest type that holds them."""
    most = np.abs(values).max(initial=0)
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
    return kind, values.astype(kind).tobytes()


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a tile or block."""
    ids = np.frombuffer(row["ids"], "<i8")
    return ids, np.frombuffer(row["data"], row["kind"]).reshape(len(ids), row["dim"]).astype(np.float64)


def statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means beside deviations, each times the root of its segment's length: products of two such rows add up to the bound."""
    if not x.shape[1]:
        return np.zeros((len(x), 2))
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    parts = [x[:, a:b] for a, b in zip(cuts, cuts[1:])]
    means = np.stack([p.mean(1) * np.sqrt(p.shape[1]) for p in parts], 1)
    return np.hstack([means, np.stack([p.std(1) * np.sqrt(p.shape[1]) for p in parts], 1)])


def segments_of(dim: int) -> list[int]:
    """Numbers of segments at each level, for vectors of dim components."""
    return [max(1, min(dim, n)) for n in LEVELS]


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise integer products; beyond what doubles hold exactly by Python's integers, held to the range of a long."""
    if len(q) == 0 or q.shape[1] * np.abs(q).max(initial=0) * np.abs(x).max(initial=0) < 2**53:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    whole = ([int(v) for v in row] for row in q), ([int(v) for v in row] for row in x)
    return np.array([min(max(sum(a * b for a, b in zip(r, s)), LONG[0]), LONG[1]) for r, s in zip(*whole)], np.int64)


class TopK:
    """The k best (score, id) of each query so far; ties go to the smaller id.

    left counts the pairs that met, those that each level left, and those that were multiplied.
    """

    def __init__(self, q: np.ndarray, k: int):
        self.q, self.k = q, k
        self.stats = [statistics(q, s) for s in segments_of(q.shape[1])]
        self.floor = np.full(len(q), -np.inf)
        self.best = [np.zeros(0, np.int64)] * 4  # query, score, id, place
        self.left = np.zeros(len(self.stats) + 2, np.int64)

    def offer(self, x: np.ndarray, ids: np.ndarray, places: np.ndarray, own: np.ndarray) -> None:
        """own: for each query, its own row among x, or -1."""
        nq, nx = len(self.q), len(x)
        a, b = np.divmod(np.arange(nq * nx), nx) if nq * nx else (np.zeros(0, int),) * 2
        self.left[0] += nq * nx
        whole, bound = True, np.zeros(len(a))
        for level, segments in enumerate(segments_of(x.shape[1])):
            of_q, of_x = self.stats[level], statistics(x, segments)
            if whole:
                bound = (of_q @ of_x.T).reshape(-1)
            elif len(a) > DENSE * nq * nx:
                bound = (of_q @ of_x.T)[a, b]
            else:
                bound = np.concatenate([np.einsum("ij,ij->i", of_q[a[k : k + 65536]], of_x[b[k : k + 65536]]) for k in range(0, len(a), 65536)] or [np.zeros(0)])
            bound = bound + 1e-6 * (1 + np.abs(bound))
            left = bound >= self.floor[a]
            if not left.all():
                a, b, bound, whole = a[left], b[left], bound[left], False
            self.left[1 + level] += len(a)
        order = np.lexsort((-bound, a))
        order = order[own[a[order]] != b[order]]
        a, b, bound = a[order], b[order], bound[order]
        nth = np.arange(len(a)) - np.searchsorted(a, np.arange(nq))[a] if len(a) else a
        turn = np.searchsorted(np.array(FIRST) * self.k, nth, "right")
        for t in range(len(FIRST) + 1):
            left = (turn == t) & (bound >= self.floor[a])
            self.multiply(a[left], b[left], x, ids, places)

    def multiply(self, a: np.ndarray, b: np.ndarray, x: np.ndarray, ids: np.ndarray, places: np.ndarray) -> None:
        """Exact products of queries a with rows b; the best of them and of those before stay."""
        nq = len(self.q)
        self.left[-1] += len(a)
        score = np.concatenate([exact_scores(self.q[a[k : k + 65536]], x[b[k : k + 65536]]) for k in range(0, len(a), 65536)] or [np.zeros(0, np.int64)])
        left = score >= self.floor[a]
        rows = [np.r_[old, new] for old, new in zip(self.best, (a[left], score[left], ids[b[left]], places[b[left]]))]
        order = np.lexsort((rows[3], rows[2], -rows[1].astype(np.float64), rows[0])) if np.abs(rows[1]).max(initial=0) < 2**53 else np.array(sorted(range(len(rows[0])), key=lambda i: (rows[0][i], -int(rows[1][i]), rows[2][i], rows[3][i])), int)
        rows = [r[order] for r in rows]
        starts = np.searchsorted(rows[0], np.arange(nq))
        nth = np.arange(len(rows[0])) - starts[rows[0]]
        self.best = [r[nth < self.k] for r in rows]
        full = nth == self.k - 1
        self.floor[rows[0][full]] = rows[1][full]


def top_k(df: DataFrame, k: int, query: Column, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k highest inner products of every query row with all other rows, exactly: query_id, rank, vec_id, score.

    Components become floor(scale * x) of x as double. query says of each row whether it is a query. Ties go to
    the smaller id. A row with a null id, a null vector, or a null or non-finite component takes no part, and
    vectors of unequal length do not meet; empty vectors score 0. Repeated rows are rows of their own: each
    finds the others. Fewer than k candidates: all of them. An empty table gives an empty table; other columns
    are ignored. Scores beyond the range of a long are held to it.

    Rows are packed into tiles once (a table in the shared folder); every block of about BLOCK queries meets
    every group of about GROUP vectors in a task of its own, and k rows per query leave it.
    """
    spark = df.sparkSession
    source = df.select(quoted(id_col).cast("long").alias("id"), quoted(vector_col).cast("array<double>").alias("x"), F.coalesce(query, F.lit(False)).alias("query"))
    source = source.where(F.col("id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        number = TaskContext.get().partitionId() << 32

        def out(dim: int) -> pa.RecordBatch:
            nonlocal number
            ids, query, x = (np.concatenate(part) for part in zip(*held.pop(dim)))
            kind, data = pack(np.floor(scale * x))
            number += 1
            row = [number, dim, int(query.sum()), ids.astype("<i8").tobytes(), query.astype(np.uint8).tobytes(), kind, data]
            return batch_of([row], TILES)

        for batch in batches:
            x, ids, query = batch.column("x"), batch.column("id").to_numpy(), batch.column("query").to_numpy(zero_copy_only=False)
            lengths = np.diff(x.offsets.to_numpy())
            flat, at = x.flatten().to_numpy(), np.r_[0, np.cumsum(lengths)]
            for dim in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == dim)
                for part in np.array_split(rows, -(-len(rows) // TILE)):
                    held.setdefault(dim, []).append((ids[part], query[part], flat[at[part][:, None] + np.arange(dim)]))
                    if sum(len(h[0]) for h in held[dim]) >= TILE:
                        yield out(dim)
        for dim in list(held):
            yield out(dim)

    tiles = write_table(source.mapInArrow(tile, ddl(TILES)), "tiles")
    size = tiles.agg(F.sum("queries"), F.sum(F.octet_length("ids") / 8)).first()
    blocks, groups = max(1, -(-int(size[0] or 0) // BLOCK)), max(1, -(-int(size[1] or 0) // GROUP))

    def queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                rows = np.flatnonzero(np.frombuffer(t["query"], np.uint8))
                ids, x = (part[rows] for part in unpack(t))
                block = (rows + t["tile"] * 7919) % blocks
                for b in np.unique(block).tolist():
                    m = block == b
                    places = np.stack([np.full(m.sum(), t["tile"]), rows[m]], 1)
                    yield batch_of([[t["dim"], b, ids[m].astype("<i8").tobytes(), places.astype("<i8").tobytes(), *pack(x[m])]], BLOCKS)

    asked = tiles.where("queries > 0").mapInArrow(queries, ddl(BLOCKS)).select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"))
    offered = tiles.select("*", F.pmod(F.xxhash64("tile"), F.lit(groups)).cast("int").alias("grp"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        asked = left.to_pylist()
        if not asked or not right.num_rows:
            return pa.Table.from_batches([batch_of([], FOUND)])
        qids, queries = (np.concatenate(part) for part in zip(*map(unpack, asked)))
        qplaces = np.concatenate([np.frombuffer(a["places"], "<i8").reshape(-1, 2) for a in asked])
        top = TopK(queries, k)
        numbers = right.column("tile").to_numpy()
        for n, t in enumerate(right.to_pylist()):
            ids, x = unpack(t)
            own = np.where(qplaces[:, 0] == t["tile"], qplaces[:, 1], -1)
            top.offer(x, ids, (n << 32) + np.arange(len(ids)), own)
        q, score, vec, place = top.best
        columns = [qplaces[q, 0], qplaces[q, 1], qids[q], vec, score, numbers[place >> 32], place & 0xFFFFFFFF]
        return pa.table(dict(zip(FOUND, map(pa.array, columns))))

    keys = ["dim", "block", "grp"]
    found = asked.groupBy(*keys).cogroup(offered.groupBy(*keys)).applyInArrow(search, ddl(FOUND))
    best = Window.partitionBy("query_tile", "query_row").orderBy(F.desc("score"), "vec_id", "tile", "row")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

