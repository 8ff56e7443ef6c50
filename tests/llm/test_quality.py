import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import quality
from pulsegrid.llm.queries import op6_quality_classifier

DATA = "/root/testdata/sf0.01"


def test_features_of_odd_texts():
    for text in (b"", b" ", b"\n\n", b"a", "é\U0001f600".encode(), b"x" * 10**6, b"| " * 1000):
        row = quality.features(text)
        assert len(row) == len(quality.FEATURES) and np.isfinite(row).all()


def test_model_learns_single_features_and_a_pair():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert (0, 1) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.95
    additive = quality.fit(x, (x[:, 2] > 0.3).astype(float))
    assert ((additive.score(x) > 0.5) == (x[:, 2] > 0.3)).mean() > 0.99


def test_model_without_both_labels():
    x = np.random.default_rng(0).random((5, 3))
    assert (quality.fit(x, np.ones(5)).score(x) > 0.5).all()
    assert np.allclose(quality.fit(np.zeros((0, 3)), np.zeros(0)).score(x), 0.5)


def test_held_out_accuracy(spark):
    out = op6_quality_classifier(spark, DATA).toPandas()
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas()
    assert len(out) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id]).all()
    assert out.score.between(0, 1).all() and ((out.score >= 0.5) == (out.predicted == 1)).all()
    both = out[out.held_out].merge(labels, on="doc_id")
    assert (both.predicted == both.quality).mean() > 0.95


@pytest.fixture(scope="module")
def small(spark):
    rows = [(i, "The of and in a text, as it is.\nMore of it here." if i % 2 else "BUY!! NOW!! $$$ BUY!!", "en") for i in range(60)]
    docs = spark.createDataFrame([*rows, (None, None, None), (61, "", None), (61, "", None), (62, "word " * 100_000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([*[(i, i % 2, 0) for i in range(60)], (None, 1, 0), (3, None, 0), (4, 7, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_nulls_repeats_and_clashing_columns(spark, small):
    docs, labels = small
    out = quality.quality_scores(docs, labels).collect()
    assert len(out) == 64 and all(0 <= r.score <= 1 for r in out)
    assert all(r.predicted == r.doc_id % 2 for r in out if r.doc_id is not None and r.doc_id < 60)
    docs = docs.withColumn("_score", F.lit("mine"))
    kept = quality.keep_good(docs, labels)
    assert {r._score for r in kept.collect()} == {"mine"}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= set(range(1, 60, 2))
    assert not {r.doc_id for r in kept.collect()} & set(range(0, 60, 2))


def test_empty_tables(spark, small):
    docs, labels = small
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(docs, labels.where(F.lit(False))).count() == 64


def test_fit_is_bounded(spark, small):
    docs, labels = small
    out = quality.quality_scores(docs, labels, fit_rows=10).collect()
    assert len(out) == 64
