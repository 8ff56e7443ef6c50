import numpy as np
import pytest

from pulsegrid.llm import near_dedup
from pulsegrid.llm.hashing import chunked, mix, shingles
from pulsegrid.llm.queries import op1_near_dedup

from tests.llm.brute import brute_classes, runs

DATA = "/root/testdata/sf0.01"


def test_shingles_are_the_runs_of_words():
    texts = ["a b c d e f", "", " \t", "a b", "x\n" * 9, "é ü ß 1 2 3", "w" * 5000 + " a b c d"]
    doc, h, n = shingles([t.encode() for t in texts], 5)
    for i, t in enumerate(texts):
        assert sorted(n[doc == i].tolist()) == sorted(runs(t).values())
    assert list(chunked([b"aa", b"b" * 50, b""], 10)) == [(0, 1), (1, 2), (2, 3)]


@pytest.mark.parametrize("top", [1, 2, 9, 40])
def test_signatures_are_unbiased_for_weighted_jaccard(top):
    rng = np.random.default_rng(top)
    a, b = rng.integers(0, top + 1, (2, 80))
    b[:50] = a[:50]
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    base, equal = rng.integers(0, 2**63, 80).astype(np.uint64), []
    for s in range(60):
        e = mix(base + np.uint64(s * 7919))
        doc = np.r_[np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)]
        sig = near_dedup.bag_minhash(doc, np.r_[e[a > 0], e[b > 0]], np.r_[a[a > 0], b[b > 0]], 2)
        equal.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(equal) - want) < 0.025


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


@pytest.mark.parametrize("n", [16, 64, 128, 256, 1024, 4096])
def test_regular_words_have_hashes_of_their_own(n):
    from pulsegrid.llm.hashing import words_of

    a = thue_morse(n)
    texts = [a, a.translate(str.maketrans("ab", "ba")), a[1:], a + "a", "a" * n, "\0" * n, "\0" * (n + 1), "é" * n]
    assert len(set(words_of([t.encode() for t in texts])[0].tolist())) == len(texts)


def test_texts_with_a_regular_word_are_not_linked(spark):
    a = thue_morse(1024)
    first = " ".join("w%d" % i for i in range(10))
    rows = [(1, f"{first} {a} {first}"), (2, f"{first} {a.translate(str.maketrans('ab', 'ba'))} {first}")]
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == [(1, 1), (2, 2)]


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.class_id) for r in op1_near_dedup(spark, DATA).collect()), key=str)
    assert got == brute_classes(docs)


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(5)
    word = lambda: "w%d" % rng.integers(10**6)
    hub = [word() for _ in range(200)]
    rows = [(1, " ".join(hub))]
    for i in range(600):  # each near the hub, most not near each other
        w = list(hub)
        for k in rng.choice(200, 4, replace=False):
            w[k] = word()
        rows.append((10 + i, " ".join(w)))
    rows += [(2000, None), (2001, ""), (2002, " "), (2003, "a b"), (2004, "a b"), (2004, "a b"), (2005, "a b c"), (None, "a b"), (None, "lone words of a null id here"), (2006, "q " * 50_000), (2007, "q " * 50_500)]
    return rows, spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, class_id string").repartition(3)


def test_hub_nulls_repeats_and_long_texts(odd, monkeypatch):
    rows, df = odd
    got = sorted(((r.doc_id, r.class_id) for r in near_dedup.near_classes(df).collect()), key=str)
    assert got == brute_classes(rows)


def test_keep_one(odd):
    rows, df = odd
    from pyspark.sql import functions as F

    df = df.withColumn("_n", F.lit("mine"))
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns
    want = sorted([c for c in {c for _, c in brute_classes(rows)} if c is not None])
    got = [r.doc_id for r in kept.collect()]
    assert sorted(d for d in got if d is not None) == want and got.count(None) == 1


def test_empty_table(odd):
    assert near_dedup.near_classes(odd[1].limit(0)).count() == 0 and near_dedup.keep_one(odd[1].limit(0)).count() == 0


@pytest.fixture(scope="module")
def template(spark):
    """Pairs just over the similarity, in a group of texts that are all just under it to each other."""
    rng = np.random.default_rng(8)
    base, rows = ["t%d" % i for i in range(2000)], []
    for i in range(30):
        places = rng.choice(np.arange(5, 1990, 5), 47, replace=False)
        for j in range(2):
            w = list(base)
            for k in np.r_[places[:3], places[3 + 22 * j : 25 + 22 * j]]:
                w[k] = "both%d_%d" % (i, k) if k in places[:3] else "own%d_%d_%d" % (i, j, k)
            rows.append((2 * i + j, " ".join(w)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_pairs_over_the_similarity_in_a_template_group(template):
    rows, df = template
    want = brute_classes(rows)
    assert len({c for _, c in want}) == 30
    assert sorted(((r.doc_id, r.class_id) for r in near_dedup.near_classes(df).collect()), key=str) == want


def test_pairs_over_the_similarity_across_the_parts_of_a_bucket(template, monkeypatch):
    monkeypatch.setattr(near_dedup, "MEET", 8)
    rows, df = template
    assert sorted(((r.doc_id, r.class_id) for r in near_dedup.near_classes(df).collect()), key=str) == brute_classes(rows)


def test_meet_gives_groups_out_as_they_end():
    """Groups of 300 in batches of 512: what one task holds is a group and a batch, whatever it reads."""
    import numpy as np
    import pyarrow as pa

    from pulsegrid.llm import near_dedup

    rng, read = np.random.default_rng(0), []
    rows = [(g, 0, 1, b"%016d" % (g * 300 + i), rng.integers(0, 256, 96, dtype=np.uint8).tobytes()) for g in range(60) for i in range(300)]
    rows[7] = (*rows[7][:4], rows[3][4])
    rows[513] = (*rows[513][:4], rows[512][4])

    def batches():
        for k in range(0, len(rows), 512):
            read.append(k)
            part = list(zip(*rows[k : k + 512]))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.int64()), pa.array(part[3], pa.binary()), pa.array(part[4], pa.binary())], names=["bucket", "part", "parts", "key", "sig"])

    out = near_dedup.meet(batches())
    first = next(out)
    assert len(read) == 1 and first.num_rows == 1
    rest = [r for b in out for r in b.to_pylist()]
    assert [(r["a"], r["b"]) for r in first.to_pylist() + rest] == [(rows[3][3], rows[7][3]), (rows[512][3], rows[513][3])]


def test_keep_one_of_an_id_with_several_texts(spark):
    """Rows of one id with different texts of one class, and the same rows again: one row stays, whatever the order."""
    from pulsegrid.llm.near_dedup import keep_one

    words = [f"w{i}" for i in range(60)]
    near = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(["first", *words[1:]])]
    rows = [(5, t, i) for i, t in enumerate(near)] * 2 + [(7, near[0], 9), (8, "something else altogether", 1), (None, near[1], 4)]
    kept = set()
    for parts in (1, 5):
        got = keep_one(spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(parts)).collect()
        assert sorted((r.doc_id for r in got), key=str) == [5, 8] and {r.text for r in got} <= {*near, "something else altogether"}
        kept.add(next(r.text for r in got if r.doc_id == 5))
    assert len(kept) == 1
