import zlib

import numpy as np

from pulsegrid.llm import sharding
from pulsegrid.llm.sharding import boxes, hypergeometric, matrix_row, shard_rows


def test_matrix_has_exact_margins():
    counts = np.array([5, 0, 17, 1, 40, 12])
    _, _, sizes = boxes(int(counts.sum()), 7, 4)
    rows = np.array([matrix_row(i, counts, sizes, 3) for i in range(len(counts))])
    assert (rows >= 0).all() and (rows.sum(1) == counts).all() and (rows.sum(0) == sizes).all()


def test_matrix_entries_follow_the_hypergeometric_law():
    counts, sizes = np.array([6, 4, 10]), np.array([8, 7, 5])
    seen = [[matrix_row(i, counts, sizes, s) for i in range(3)] for s in range(3000)]
    mean = np.mean(seen, axis=0)
    assert np.abs(mean - np.outer(counts, sizes) / 20).max() < 0.12
    var = np.var([x[0][0] for x in seen])
    assert abs(var - 6 * (8 / 20) * (12 / 20) * (14 / 19)) < 0.12


def test_large_draws_agree_with_small_ones(monkeypatch):
    a = [hypergeometric(300, 500, 200, np.random.default_rng(s)) for s in range(4000)]
    monkeypatch.setattr(sharding, "NUMPY_ROWS", 1)
    b = [hypergeometric(300, 500, 200, np.random.default_rng(s)) for s in range(4000)]
    assert abs(np.mean(a) - np.mean(b)) < 0.6 and 0.9 < np.std(a) / np.std(b) < 1.1
    assert hypergeometric(3, 0, 2, np.random.default_rng(1)) == 2
    big = hypergeometric(4 * 10**11, 6 * 10**11, 10**10, np.random.default_rng(1))
    assert abs(big - 4 * 10**9) < 10**6


def test_shards_are_exact_and_rows_whole(spark):
    df = spark.range(1003).selectExpr("id % 900 as doc_id", "case when id % 7 = 0 then null else 't' end as text", "id as shard").repartition(5)
    out = shard_rows(df, 8, seed=1, box_rows=20).collect()
    assert sorted((r.doc_id, r.text or "") for r in out) == sorted((r.doc_id, r.text or "") for r in df.collect())
    for s in range(8):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) in (125, 126)


def test_few_rows_and_none(spark):
    one = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [(r.shard, r.slot) for r in shard_rows(one, 40).collect()] == [(0, 0)]
    assert shard_rows(one.limit(0), 40).count() == 0


def test_places_are_uniform(spark):
    df = spark.range(20).repartition(3).select("id")
    hits = np.zeros((20, 4))
    for seed in range(12):
        for r in shard_rows(df, 4, seed=seed).collect():
            hits[r.id, r.shard] += 1
    assert ((hits - 3) ** 2 / 2.25).sum() < 110  # 57 expected


def test_columns_of_the_names_in_use(spark):
    names = ["_file", "_row", "_box", "_shard", "_first", "_order", "_from", "c0", "c 1", "`x`"]
    df = spark.range(50).repartition(3)
    for k, n in enumerate(names):
        df = df.withColumn(n, df["id"] * 100 + k)
    out = shard_rows(df, 4, seed=1, box_rows=5)
    assert out.columns == ["id", *names, "shard", "slot"]
    assert sorted(tuple(r)[1:-2] for r in out.collect()) == [tuple(i * 100 + k for k in range(len(names))) for i in range(50)]


def test_many_boxes_are_split_at_once():
    import time

    total, began = np.full(40_000, 50_000), time.time()
    got = sharding.split(total, 10**9, np.random.default_rng(0))
    assert got.sum() == 10**9 and (got >= 0).all() and (got <= total).all() and abs(got.std() - (50_000 * 0.25) ** 0.5) < 3
    assert time.time() - began < 1


def test_query_against_zlib(spark):
    from pulsegrid.llm.queries import op2_sharding

    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = op2_sharding(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all((r["size"], r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id]), "rows", None) for r in rows)
    slots = [sorted(r.slot for r in rows if r.shard == k) for k in range(40)]
    assert all(x == list(range(len(x))) for x in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1
