import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import mixing
from pulsegrid.llm.mixing import MARGINS, Mix
from pulsegrid.llm.queries import op7_mixing

DATA = "/root/testdata/sf0.01"


def brute_rake(cells, targets, cycles):
    w = {c: 1.0 for c in cells}
    total = sum(cells.values())
    for _ in range(cycles):
        for k, _m in enumerate(MARGINS):
            for cat, t in targets[k].items():
                mine = [c for c in cells if c[k] == cat]
                now = sum(cells[c] * w[c] for c in mine) / total
                for c in mine:
                    w[c] *= t / now
    return w


def test_raking_against_brute_force(spark):
    rng = np.random.default_rng(0)
    cells = {(s, g, t): float(rng.integers(1, 1000)) for s in ("a", "b", None) for g in ("x", "y") for t in ("p", "q", "r") if rng.random() < 0.9}
    df = spark.createDataFrame([(*c, n, 1) for c, n in cells.items()], "source string, lang string, topic string, tokens double, docs long")
    mix = Mix(powers={"source": 0.5, "lang": 0.0, "topic": 1.0}, cycles=40)
    got = {(r.source, r.lang, r.topic): r.weight for r in mixing.rake(df, mix).collect()}
    few = {(r.source, r.lang, r.topic): r.weight for r in mixing.rake(df, Mix(powers=mix.powers, cycles=1, tolerance=0)).collect()}
    targets = []
    for k, m in enumerate(MARGINS):
        sums = {}
        for c, n in cells.items():
            sums[c[k]] = sums.get(c[k], 0) + n
        powered = {c: n ** mix.powers[m] for c, n in sums.items()}
        targets.append({c: n / sum(powered.values()) for c, n in powered.items()})
    once, want = brute_rake(cells, targets, 1), brute_rake(cells, targets, 200)
    assert all(abs(few[c] - once[c]) < 1e-9 for c in cells)
    assert all(abs(got[c] - want[c]) < 1e-3 * want[c] for c in cells)


def test_topics_and_words():
    texts = ["", "a|b", "x" * 97 + "123", "x" * 96 + "1234", "é" * 94 + "!" * 6, "é" * 95 + "!" * 5, "line of text\n" * 3, "plain words \u3000 here\x0b\x1c", "a|1#\n"]
    names, words = mixing.topics_and_tokens([t.encode() for t in texts])
    assert names == ["empty", "table", "prose", "numeric", "symbols", "prose", "lines", "prose", "table"]
    assert words == [0, 1, 1, 1, 1, 1, 9, 5, 1]


def test_shares_of_the_sample(spark):
    rows = [(i, "word " * 10, "en", "big" if i % 10 else "small") for i in range(200)]
    out = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), Mix(powers={"source": 0.0}))
    got = {(r.margin, r.category): (r.target, r.raked, r.expected) for r in mixing.margin_shares(out, Mix(powers={"source": 0.0})).collect()}
    assert np.allclose(got["source", "small"], (0.5, 0.5, 0.2)) and np.allclose(got["lang", "en"], (1, 1, 1)) and len(got) == 4


def test_given_targets_and_budget(spark):
    df = spark.createDataFrame([("a", "x", "p", 700.0, 1), ("b", "x", "p", 200.0, 1), ("c", "x", "p", 100.0, 1)], "source string, lang string, topic string, tokens double, docs long")
    raked = mixing.rake(df, Mix(targets={"source": {"a": 0.5, "b": 0.5, "z": 3.0}}))
    assert {r.source: round(r.weight * r.tokens, 3) for r in raked.collect()} == {"a": 500.0, "b": 500.0, "c": 0.0}
    out = {r.source: r.probability for r in mixing.calibrate(raked, 0.5).collect()}
    assert out["b"] == 1.0 and abs(out["a"] * 700 + 200 - 500) < 1e-6 and out["c"] == 0


def test_query_is_calibrated(spark):
    out = op7_mixing(spark, DATA).toPandas()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").toPandas()
    assert sorted(out.doc_id) == sorted(docs.doc_id) and out.probability.between(0, 1).all()
    import re

    words = dict(zip(docs.doc_id, [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in docs.text]))
    assert (out.tokens == out.doc_id.map(words)).all()
    assert abs((out.tokens * out.probability).sum() / out.tokens.sum() - 0.5) < 1e-6
    share = (out.tokens * out.weight).groupby(out.lang).sum() / out.tokens.sum()
    powered = out.groupby("lang").tokens.sum() ** 0.7
    assert np.allclose(share, powered / powered.sum(), atol=1e-3)
    assert abs(out.kept.mean() - out.probability.mean()) < 0.05


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, "word " * (i % 9 + 1), None if i % 5 == 0 else "en", None if i % 7 == 0 else "s", "keep") for i in range(300)]
    return spark.createDataFrame([*rows, (None, None, None, None, None), (400, "", "en", "s", ""), (400, "", "en", "s", ""), (401, "w" * 10**6, "", "", None)], "doc_id long, text string, lang string, source string, topic string")


def test_nulls_repeats_and_clashing_columns(odd):
    few = Mix(powers=mixing.MIX.powers, cycles=3)
    rows = mixing.mixed(odd, few).collect()
    assert len(rows) == 304 and all(r._probability is not None and r._kept is not None for r in rows)
    assert len({r._kept for r in rows if r.doc_id == 400}) == 1 and {r._topic for r in rows if r.doc_id in (None, 400)} == {"empty"}
    kept = mixing.sample_mix(odd, few)
    assert kept.columns == odd.columns and 60 < kept.count() < 240


def test_columns_of_the_names_in_use(odd):
    clash = odd.where("doc_id < 50").withColumn("_tokens", F.lit("mine")).withColumn("_kept", F.lit(7))
    kept = mixing.sample_mix(clash)
    assert kept.columns == clash.columns and {(r._tokens, r._kept) for r in kept.collect()} == {("mine", 7)}


def test_empty_table(odd):
    assert mixing.mixed(odd.limit(0)).count() == 0
    assert mixing.sample_mix(odd.where("text = ''")).count() in (0, 2)


def test_whole_budget_keeps_everything(odd):
    assert mixing.sample_mix(odd, Mix(budget=1.0)).count() == odd.count()
