import hashlib
import re

import numpy as np
import pytest

from pulsegrid.llm import recompression as rc
from pulsegrid.llm.queries import op4_recompression_dedup
from pulsegrid.llm.repeats import flat

DATA = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width=20):
    seen, out = set(), {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0)):
        words = WORD.findall(rows[i][1] or "")
        gone = [False] * len(words)
        for s in range(len(words) - width + 1):
            w = tuple(words[s : s + width])
            if w in seen:
                gone[s : s + width] = [True] * width
            seen.add(w)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.setdefault(rows[i][0], []).append((len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def collected(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, r.kept_sha256))
    return {k: sorted(v) for k, v in out.items()}


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(0)
    passage = rng.integers(0, 6, 60).astype(np.uint64)
    rows = [np.concatenate([rng.integers(0, 6, rng.integers(0, 40)).astype(np.uint64), passage, rng.integers(0, 6, 30).astype(np.uint64)]) for _ in range(40)]
    rows += [np.zeros(90, np.uint64), np.tile(np.arange(2, dtype=np.uint64), 60), passage]
    units, firsts = np.concatenate(rows), np.r_[0, np.cumsum([len(r) for r in rows])]
    a = rc.window_anchors(units, firsts)
    windows = a.high - a.low + 1
    start = flat(a.low, windows)
    want = [s for lo, hi in zip(firsts, firsts[1:]) for s in range(lo, hi - 19)]
    assert start.tolist() == want
    anchor = {}
    for s, h, at in zip(start.tolist(), np.repeat(a.hash, windows).tolist(), np.repeat(a.at, windows).tolist()):
        assert s <= at < s + 20
        assert anchor.setdefault(units[s : s + 20].tobytes(), (h, at - s)) == (h, at - s)


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert collected(op4_recompression_dedup(spark, DATA)) == brute(rows)


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(2)
    text = lambda n: " ".join(rng.choice(["a", "b", "é", "d e", "\U0001f600"], n))
    passage = text(60)
    rows = [(i, text(int(rng.integers(0, 60))) + (" " if i % 2 else "\n\t") + (passage if i % 3 else passage[8:90]) + " " + text(9)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " ".join(passage.split()[:19])), (103, "z " * 5000), (105, "a b " * 900), (106, rows[4][1]), (106, rows[4][1]), (None, passage + " x"), (None, passage), (107, "w" * 100_000)]
    return rows, spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, kept string").repartition(4)


def test_odd_rows(odd):
    from pyspark.sql import functions as F

    rows, df = odd
    got, want = collected(rc.recompression_dedup(df).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))), brute(rows)
    assert {k: v for k, v in got.items() if k is not None} == {k: v for k, v in want.items() if k is not None}
    assert sum(v[1] for v in got[None]) == sum(v[1] for v in want[None])


def test_many_parts_of_blocks(odd, monkeypatch):
    from pulsegrid.llm import repeats
    from pyspark.sql import functions as F

    rows, df = odd
    monkeypatch.setattr(repeats, "MEET_BLOCKS", 2)
    found = rc.recompression_dedup(df.repartition(9)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    got, want = collected(found), brute(rows)
    assert {k: v for k, v in got.items() if k is not None} == {k: v for k, v in want.items() if k is not None}


def test_parted_contexts_of_frequent_anchors(odd, monkeypatch):
    from pulsegrid.llm import repeats
    from pyspark.sql import functions as F

    rows, df = odd
    monkeypatch.setattr(repeats, "HOT", 4)
    found = rc.recompression_dedup(df.repartition(9)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    got, want = collected(found), brute(rows)
    assert {k: v for k, v in got.items() if k is not None} == {k: v for k, v in want.items() if k is not None}


def test_a_regular_word_is_not_its_complement(spark):
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    first = " ".join("w%d" % i for i in range(10))
    rows = [(1, f"{first} {a} {first}"), (2, f"{first} {a.translate(str.maketrans('ab', 'ba'))} {first}"), (3, f"{first} {a} {first}")]
    got = rc.recompression_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (2, 0), (3, 21)]


def test_texts(odd):
    rows, df = odd
    out = rc.dedup_texts(df)
    assert out.columns == df.columns
    got = {r.doc_id: r.text for r in out.collect() if r.doc_id != 106}
    assert got[100] is None and got[101] == "" and got[107] == "w" * 100_000 and got[103] == "z"
    assert rc.recompression_dedup(df.limit(0)).count() == 0 and rc.dedup_texts(df.limit(0)).count() == 0
