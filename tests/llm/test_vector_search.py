import numpy as np
from pyspark.sql import functions as F

from pulsegrid.llm.vector_search import TopK, statistics, top_k


def brute(rows, k):
    ok = [(p, i, [int(np.floor(256 * v)) for v in x]) for p, (i, x) in enumerate(rows) if i is not None and x is not None and all(v is not None and np.isfinite(v) for v in x)]
    out = []
    for p, i, x in ok:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), j) for o, j, y in ok if o != p and len(y) == len(x))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_bounds_hold_and_tighten():
    rng = np.random.default_rng(0)
    q, x = rng.integers(-256, 256, (2, 40, 30)).astype(float)
    last = None
    for s in (1, 4, 16, 64):
        bound = statistics(q, s) @ statistics(x, s).T
        assert (bound >= q @ x.T - 1e-6).all()
        last = bound
    assert np.allclose(last, q @ x.T)


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 12))
    x[300:420] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(50, x[3].tolist()), (50, x[3].tolist()), (None, x[0].tolist()), (800, None), (850, [1.0, None] * 6), (900, [float("nan")] * 12), (950, [1.0, 2.0]), (951, [3.0, -1.0]), (1000, []), (1001, []), (1050, [1e300] * 5), (1051, [2e300] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).repartition(3)
    got = sorted(tuple(r) for r in top_k(df, 5, F.col("vec_id") % 50 == 0).collect() if r.query_id != 1050)
    assert got == [r for r in brute(rows, 5) if r[0] != 1050]
    assert [tuple(r) for r in top_k(df.where("vec_id >= 1050"), 5, F.col("vec_id") % 50 == 0).collect()] == [(1050, 1, 1051, 2**63 - 1)]
    assert top_k(df.limit(0), 5, F.col("vec_id") % 50 == 0).count() == 0


def test_many_tiles_give_what_one_gives():
    rng = np.random.default_rng(2)
    q, x = rng.integers(-50, 50, (9, 20)).astype(float), rng.integers(-50, 50, (900, 20)).astype(float)
    ids, top = rng.permutation(900), TopK(q, 5)
    for k in range(0, 900, 100):
        top.offer(x[k : k + 100], ids[k : k + 100], np.arange(k, k + 100), np.full(9, -1))
    for n in range(9):
        want = sorted((-int(s), int(i)) for s, i in zip(x @ q[n], ids))[:5]
        m = top.best[0] == n
        assert [(-int(s), int(i)) for s, i in zip(top.best[1][m], top.best[2][m])] == want


def test_fewer_than_half_of_the_pairs_are_multiplied():
    """On the largest given table, as the query has it: one tile, queries divisible by 50."""
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    x, ids = np.floor(256 * np.array(table.column("embedding").to_pylist(), float)), table.column("vec_id").to_numpy()
    asked = np.flatnonzero(ids % 50 == 0)
    top = TopK(x[asked], 5)
    top.offer(x, ids, np.arange(len(x)), asked)
    assert top.left[0] == len(asked) * len(x) and top.left[-1] < top.left[0] / 2
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    for n in range(len(asked)):
        assert sorted(top.best[1][top.best[0] == n]) == sorted(np.sort(scores[n])[-5:])
