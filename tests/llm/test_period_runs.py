import random

import pytest

from pulsegrid.llm import period_runs as pr
from pulsegrid.llm.period_runs import collapsed, period_runs, runs_of
from pulsegrid.llm.queries import repeated_tails


def brute(words):
    """All maximal stretches by every period; of one stretch the least period."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = j
    return sorted(((i, n, q) for (i, n), q in out.items()), key=lambda r: (r[0], r[2]))


def some_texts(rng):
    for _ in range(rng.randrange(1, 6)):
        n, letters = rng.randrange(0, 70), rng.choice([1, 2, 3, 6])
        w = [b"w%d" % rng.randrange(letters) for _ in range(n)]
        if rng.random() < 0.5 and n:
            a, p = rng.randrange(n), rng.randrange(1, max(2, n // 4))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        yield w


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(150):
        texts = list(some_texts(rng))
        assert runs_of(texts) == [brute(w) for w in texts]


def test_strings_with_many_and_with_no_runs():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 800:
        a, b = b, b + a
    thue = [b"%d" % (bin(i).count("1") % 2) for i in range(1024)]
    nested = ([b"a"] * 7 + [b"b"]) * 5 + [b"c"] + ([b"x", b"y", b"x", b"y", b"x", b"y", b"x", b"y", b"z"] * 4)
    for w in (b, thue, nested, [b"a"] * 500, [b"ab", b"a", b"b"] * 40, [b"a"] * 5, [b"a"] * 6, []):
        assert runs_of([w, w, [b"a"]]) == [brute(w), brute(w), []]
    # one run after another may not touch across texts
    assert runs_of([[b"a"] * 3, [b"a"] * 3, [b"b"] * 6]) == [[], [], [(0, 6, 1)]]


def test_long_texts_take_time_in_proportion():
    rng = random.Random(1)
    words = [b"%d" % rng.randrange(10**6) for _ in range(100_000)]
    assert runs_of([[words[i % 3] for i in range(100_000)]]) == [[(0, 100_000, 3)]]
    assert runs_of([[words[i % 25_000] for i in range(100_000)]]) == [[(0, 100_000, 25_000)]]
    # a phrase that comes again and again after other words is no run
    assert runs_of([[w for i in range(15_000) for w in (words[i], b"p", b"q", b"r", b"s", b"t")]]) == [brute([w for i in range(50) for w in (words[i], b"p", b"q", b"r", b"s", b"t")])]


def test_what_runs_leave(spark):
    assert collapsed([b"a"] * 6 + [b"b"], [(0, 6, 1)]) == b"a b"
    assert collapsed([], []) == b""


def test_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(pr, "CHUNK_WORDS", 20)
    texts = [None, "", " \t\n", "a " * 6, "a a " * 7, "x y " * 4 + "é", "a b c d " * 9, "a " * 6]
    clash = "doc_id long, text string, runs string, n_words string, collapsed int, raw binary, order string"
    table = spark.createDataFrame([(i if i != 3 else None, t, "r", "n", 1, b"x", "o") for i, t in enumerate(texts)] * 2, clash).repartition(3)
    got = period_runs(table)
    assert got.columns == ["doc_id", "text", "raw", "order", "n_words", "runs", "collapsed"]
    rows = got.collect()
    assert len(rows) == 16
    for r in rows:
        words = (r.text or "").encode().split()
        assert (r.n_words, [tuple(x) for x in r.runs]) == (len(words), brute(words)) and r.raw == b"x" and r.collapsed == collapsed(words, brute(words))
    assert period_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_repeated_tails(spark):
    import zlib

    rows = [(i if i else None, " \t".join(f"w{k}" for k in range(i % 40))) for i in range(200)]
    got = {r.doc_id: r.text for r in repeated_tails(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc, text in rows:
        words = text.split()
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            text = " ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n))
        assert got[doc] == text


def test_rows_do_not_move(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert "Exchange" not in period_runs(docs)._jdf.queryExecution().executedPlan().toString()
