
import corpus_pipeline as cp
import numpy as np
import pytest
from pulsegrid.llm.mixing import draw
from pyspark.sql import functions as F
from tests.llm.brute import brute_classes
from tokenizers import Tokenizer

import public_tokenizers

DATA = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in cp.STAGES:
        out = cp.write_table(stage(spark, docs, DATA), name)
        rows = {r.doc_id: r for r in out.collect()}
        assert len(rows) == out.count() and set(rows) <= set(before)
        if name != "encoding":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        if name == "quality":
            assert all(rows[d] == before[d] for d in rows)
            known = [d for d in before if d in labels]
            assert np.mean([(d in rows) == (labels[d].quality == 1) for d in known]) > 0.95
        if name == "near_duplicates":
            assert set(rows) == {c for _, c in brute_classes([(r.doc_id, r.text) for r in before.values()])}
        if name == "substrings":
            seen = set()
            for d in sorted(before):
                t = before[d].text.encode()
                gone = np.zeros(len(t), bool)
                for s in range(len(t) - 99):
                    gone[s : s + 100] |= t[s : s + 100] in seen
                    seen.add(t[s : s + 100])
                kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
                assert rows[d].text == kept.decode() if t.isascii() else abs(len(rows[d].text.encode()) - len(kept)) <= 3 * (1 + (np.diff(gone.astype(int)) != 0).sum())
        if name == "mixing":
            assert all(rows[d] == before[d] for d in rows) and 0.3 < sum(len(r.text) for r in rows.values()) / sum(len(r.text) for r in before.values()) < 0.7
        if name == "encoding":
            tok = Tokenizer.from_file(public_tokenizers.path(cp.TOKENIZER))
            assert set(rows) == set(before)
            for d, r in rows.items():
                ids = tok.encode(before[d].text, add_special_tokens=False).ids
                assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids and r.n_tokens == len(ids)
        docs, before = out, rows


def test_draws_are_uniform(spark):
    u = [r.u for r in spark.range(4000).select(draw(F.col("id"), F.lit("t"), 1).alias("u")).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.02


@pytest.mark.parametrize("empty", [True, False])
def test_odd_documents(spark, tmp_path, empty):
    rows = [(1, "One text of a few words, as it is.", "en", None, 3), (1, "One text of a few words, as it is.", "en", None, 3), (2, None, None, "s", None), (None, "", "en", "s", 0), (3, "x" * 300_000, "de", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    (docs.limit(0) if empty else docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = cp.run(spark, str(tmp_path)).collect()
    assert len(out) <= (0 if empty else 4)


def test_extra_columns_with_clashing_names(spark, tmp_path):
    """Names that stages use inside go through the whole pipeline up to the last stage, which has columns of its own."""
    clash = ["key", "kept", "class_id", "_keep", "n_removed", "topic", "weight", "label", "score", "ids", "raw", "block"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    plain, wide = tmp_path / "plain", tmp_path / "wide"
    for folder, table in ((plain, docs), (wide, docs.select("*", *[F.lit(f"of {c}").alias(c) for c in clash]))):
        table.write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    rows = lambda df: sorted((r.doc_id, r.source, r.lang, r.n_tokens, bytes(r.ids)) for r in df.collect())
    assert rows(cp.run(spark, str(plain))) == rows(cp.run(spark, str(wide)))
    table = spark.read.parquet(f"{wide}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        table = cp.write_table(stage(spark, table, str(wide)), name)
        assert table.columns == docs.columns + clash
    assert table.select(*clash).distinct().collect() == [tuple(f"of {c}" for c in clash)]
