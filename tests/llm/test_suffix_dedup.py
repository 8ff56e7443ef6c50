import hashlib

import numpy as np
import pytest

from pulsegrid.llm import repeats, suffix_dedup as sd
from pulsegrid.llm.queries import op10_suffix_dedup

DATA = "/root/testdata/sf0.001"


def brute(rows, width=100):
    seen, out = set(), {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0)):
        t = (rows[i][1] or "").encode()
        gone = np.zeros(len(t) + 1, bool)
        for s in range(len(t) - width + 1):
            w = t[s : s + width]
            if w in seen:
                gone[s : s + width] = True
            seen.add(w)
        g = gone[: len(t)]
        edges = np.diff(np.r_[0, g.astype(np.int8), 0])
        out.setdefault(rows[i][0], []).append((len(t), int(g.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~g].tobytes()).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def collected(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    return {k: sorted(v) for k, v in out.items()}


def digest(df):
    from pyspark.sql import functions as F

    return df.select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def contexts(parts, windows, window):
    units = np.frombuffer(b"".join(parts), np.uint8)
    n = np.array(list(map(len, parts)))
    z = np.zeros(len(parts), np.int64)
    return repeats.Contexts(z.astype(np.uint64), z, np.array(windows), z, z, z, np.cumsum(n) - n, units)


@pytest.mark.parametrize("size", [10**6, 60, 25])
def test_shards_merge_to_the_same_classes(size):
    rng = np.random.default_rng(0)
    parts = [bytes(rng.integers(0, 2, 20 + rng.integers(0, 9), dtype=np.uint8)) for _ in range(60)]
    windows = [len(p) - 7 for p in parts]
    classes = sd.window_classes(contexts(parts, windows, 8), 8, size)
    content = [p[s : s + 8] for p, w in zip(parts, windows) for s in range(w)]
    assert len(set(zip(classes.tolist(), content))) == len(set(content)) == len(set(classes.tolist()))


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 3, 500, dtype=np.uint8)
    starts, ends = np.array([0, 200, 203]), np.array([200, 203, 500])
    end = np.repeat(ends, ends - starts)
    order = sd.suffix_array(data, end, 300)
    keys = [data[i : end[i]].tobytes() for i in order]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(500))
    shared = sd.common_prefixes(data, order, starts, ends, end, 40)
    for k in range(1, 500):
        i, j = order[k], order[k - 1]
        n = 0
        while n < 40 and i + n < end[i] and j + n < end[j] and data[i + n] == data[j + n]:
            n += 1
        assert shared[i] == n


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert collected(op10_suffix_dedup(spark, DATA)) == brute(rows)


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(2)
    text = lambda n: "".join(rng.choice(list("abcdé \n"), n))
    passage = text(260)
    rows = [(i, text(int(rng.integers(0, 400))) + (passage if i % 3 else passage[40:190]) + text(50)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, passage[:99]), (103, "z" * 5000), (104, "z" * 99), (105, "ab" * 3000), (106, rows[4][1]), (106, rows[4][1]), (None, passage + "x"), (None, passage), (107, "y" * 100 + "\0" * 300)]
    return rows, spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, kept string").repartition(4)


def test_odd_rows(odd, monkeypatch):
    rows, df = odd
    got, want = collected(digest(sd.suffix_dedup(df))), brute(rows)
    assert {k: v for k, v in got.items() if k is not None} == {k: v for k, v in want.items() if k is not None}
    assert sum(v[1] for v in got[None]) == sum(v[1] for v in want[None])


def test_many_parts_of_blocks(odd, monkeypatch):
    rows, df = odd
    monkeypatch.setattr(repeats, "MEET_BLOCKS", 2)
    got, want = collected(digest(sd.suffix_dedup(df.repartition(9)))), brute(rows)
    assert {k: v for k, v in got.items() if k is not None} == {k: v for k, v in want.items() if k is not None}


def test_parted_contexts_of_frequent_anchors(odd, monkeypatch):
    rows, df = odd
    monkeypatch.setattr(repeats, "HOT", 4)
    got, want = collected(digest(sd.suffix_dedup(df.repartition(9)))), brute(rows)
    assert {k: v for k, v in got.items() if k is not None} == {k: v for k, v in want.items() if k is not None}


def test_a_shard_of_whole_texts():
    rng = np.random.default_rng(4)
    line = bytes(rng.integers(97, 100, 400, dtype=np.uint8))
    texts = [bytes(rng.integers(97, 99, int(n), dtype=np.uint8)) + line[int(k) :] + b"\0" * 120 for n, k in zip(rng.integers(0, 700, 40), rng.integers(0, 300, 40))]
    texts += [b"", b"ab" * 700, b"\0" * 300, line, texts[3], line[:99]]
    units, firsts, _ = sd.split_bytes(texts)
    c = sd.whole_texts(units, firsts, None)
    late, seen, want = repeats.late_windows(sd.window_classes(c)), set(), []
    for t in texts:
        for i in range(len(t) - 99):
            want.append(t[i : i + 100] in seen)
            seen.add(t[i : i + 100])
    assert late.tolist() == want


def test_texts_stay_whole_characters(odd):
    rows, df = odd
    out = sd.dedup_texts(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    got = {r.doc_id: r.text for r in out.collect() if r.doc_id != 106}
    assert got[100] is None and got[101] == "" and all("�" not in (t or "") for t in got.values()) and got[103] == "z"


def test_empty_table(odd):
    assert sd.suffix_dedup(odd[1].limit(0)).count() == 0 and sd.dedup_texts(odd[1].limit(0)).count() == 0
