"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in cycles, one feature at a time on the features' bins, and their leaf values add up
to one lookup table per feature; then the strongest pairs of features get tables the same way. A score is the
logistic of the intercept and one table entry per feature and pair, found by vectorised bin additions.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import add_columns, shielded, tune, write_table

FEATURES = (
    "log_bytes", "upper", "lower", "digit", "space", "comma_stop", "mark", "symbol", "bar", "high", "entropy", "word_length", "longest_word",
    "distinct_words", "repeated_neighbours", "marked_words", "shouted_words", "distinct_lines", "line_length", "worst_upper", "worst_symbol",
)

#: Labelled rows that the model is fitted on at most, taken by a hash of their ids.
FIT_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 64, 12, 10
ROUNDS, PAIR_ROUNDS, RATE, LEAF_WEIGHT = 120, 60, 0.15, 3.0

_class = np.zeros((256, 9))
for _k, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), b" \t\n\r\v\f", b",.;:", b"!?", b"#$%&*+<=>@^_~\\/{}[]", b"|", range(128, 256))):
    _class[list(_bytes), _k] = 1


def features(text: bytes) -> list[float]:
    """The features of one whole text, in the order of FEATURES; an empty text gives a row too."""
    n = len(text)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = (count @ _class) / max(n, 1)
    some = count[count > 0] / max(n, 1)
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    nw, nl = max(len(words), 1), max(len(lines), 1)
    ends = sum(w[-1:] in b"!#$%&*|" for w in words) / nw
    worst_upper = worst_symbol = 0.0
    for line in lines:
        if len(line) >= 20:
            bare = len(line.translate(None, b"#$%&*|"))
            worst_symbol = max(worst_symbol, 1 - bare / len(line))
            worst_upper = max(worst_upper, 1 - len(line.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")) / len(line))
    return [
        np.log1p(n), *shares.tolist(), float(-(some * np.log2(some)).sum()), sum(map(len, words)) / nw, max(map(len, words), default=0),
        len(set(words)) / nw, sum(map(eq, words, words[1:])) / nw, ends, sum(map(bytes.isupper, words)) / nw, len(set(lines)) / nl, sum(map(len, lines)) / nl, worst_upper, worst_symbol,
    ]


@dataclass
class Model:
    """Cuts between bins, and a table of additions for each feature and each pair of features."""

    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    intercept: float
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for f, (cut, table) in enumerate(zip(self.cuts, self.tables)):
            total += table[np.searchsorted(cut, x[:, f], "right")]
        coarse = [np.searchsorted(cut, x[:, f], "right") for f, cut in enumerate(self.pair_cuts)]
        for (f, g), table in self.pairs.items():
            total += table[coarse[f], coarse[g]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def quantile_cuts(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]


def gain(g, h):
    return g * g / (h + LEAF_WEIGHT)


def step_of_feature(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of up to three leaves on one feature's bins: the best cut, then the best cut of either side."""
    cg, ch = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, -1
        lg, lh = cg[a + 1 : b] - cg[a], ch[a + 1 : b] - ch[a]
        total_g, total_h = cg[b] - cg[a], ch[b] - ch[a]
        up = gain(lg, lh) + gain(total_g - lg, total_h - lh) - gain(total_g, total_h)
        k = int(up.argmax())
        return float(up[k]), a + 1 + k

    edges, (up, first) = [0, len(g)], best(0, len(g))
    if first > 0 and up > 0:
        edges.append(first)
        up, second = max(best(0, first), best(first, len(g)))
        if second > 0 and up > 0:
            edges.append(second)
    out, edges = np.zeros(len(g)), sorted(edges)
    for a, b in zip(edges, edges[1:]):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + LEAF_WEIGHT)
    return out


def step_of_pair(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best single cut of either axis, as four leaves; its gain and its table."""
    cg, ch = (np.pad(a, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for a in (g, h))

    def corners(c):
        inner, right, below, whole = c[1:-1, 1:-1], c[1:-1, -1:], c[-1:, 1:-1], c[-1, -1]
        return inner, right - inner, below - inner, whole - right - below + inner

    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    gs, hs = corners(cg), corners(ch)
    up = sum(gain(a, b) for a, b in zip(gs, hs))
    i, j = np.unravel_index(int(up.argmax()), up.shape)
    leaf = [a[i, j] / (b[i, j] + LEAF_WEIGHT) for a, b in zip(gs, hs)]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
    return float(up[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """x: rows by features, y: 0 or 1. Without rows of both labels the smoothed share of label 1 is all there is."""
    share = (y.sum() + 1) / (len(y) + 2)
    cuts = quantile_cuts(x, BINS) if len(x) else [np.zeros(0)] * x.shape[1]
    model = Model(cuts, [np.zeros(len(c) + 1) for c in cuts], float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    bins, total = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)], np.full(len(x), model.intercept)

    def residual():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, b in enumerate(bins):
            g, h = residual()
            n = len(model.tables[f])
            step = RATE * step_of_feature(np.bincount(b, g, n), np.bincount(b, h, n))
            model.tables[f] += step
            total += step[b]
    model.pair_cuts = quantile_cuts(x, PAIR_BINS)
    coarse, sides = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(model.pair_cuts)], [len(c) + 1 for c in model.pair_cuts]

    def step(f: int, g: int) -> tuple[float, np.ndarray]:
        at, shape = coarse[f] * sides[g] + coarse[g], (sides[f], sides[g])
        grad, hess = residual()
        return step_of_pair(*(np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (grad, hess)))

    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda p: -step(*p)[0])[:PAIRS]
    model.pairs = {p: np.zeros((sides[p[0]], sides[p[1]])) for p in ranked}
    for _ in range(PAIR_ROUNDS):
        for (f, g), table in model.pairs.items():
            add = RATE * step(f, g)[1]
            table += add
            total += add[coarse[f], coarse[g]]
    return model


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; rows of fold 1 are held out. A null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3))


def add_features(df: DataFrame, text_col: str = "text", out_col: str = "features") -> DataFrame:
    """df with an array of the FEATURES of each whole text; null counts as empty. No shuffle."""
    tune(df.sparkSession)

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = [features(x or b"") for x in batch.column(text_col).cast(pa.binary()).to_pylist()]
            flat = pa.array(np.array(rows, np.float64).reshape(-1))
            return [pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES)), flat)]

        return work

    return add_columns(df, [text_col], [T.StructField(out_col, T.ArrayType(T.DoubleType()), False)], make)


def labelled(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, text and quality of the rows to learn from: fit_rows at most, none of them held out.

    Rows with a null id or label, or a label other than 0 and 1, are not learned from. An id counts once for each of
    its labels, with the text of least hash if it has several. Beyond fit_rows, those with the smallest hashes of
    their ids are taken: ids alone are chosen first, and only the texts of those chosen are looked up.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 1)).distinct()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(2**30))
    ids = known.join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("place", place)
    rows = ids.count()
    if rows > fit_rows:
        ids = ids.where(F.col("place") < int(2**30 * min(1.0, 1.1 * fit_rows / rows)))
    chosen = write_table(ids.orderBy("place", "doc_id", "quality").limit(fit_rows), "labelled")
    # fit_rows rows at most
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("place", "doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fits on the labelled() rows of docs; the features of those rows alone are computed, and come to the driver."""
    sample = add_features(labelled(docs, labels, fit_rows)).select("place", "doc_id", "quality", "features").toPandas().sort_values(["place", "doc_id", "quality"])
    x = np.array(sample["features"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, sample["quality"].to_numpy(np.float64))


def add_scores(df: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """df with the probability of label 1; no shuffle. The model's tables are a few tens of KB."""
    tune(df.sparkSession)

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = [features(x or b"") for x in batch.column(text_col).cast(pa.binary()).to_pylist()]
            return [pa.array(model.score(np.array(rows, np.float64).reshape(-1, len(FEATURES))))]

        return work

    return add_columns(df, [text_col], [T.StructField(out_col, T.DoubleType(), False)], make)


def quality_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.5 on) of every row of docs (doc_id, text).

    Every text is read once, to be scored; only the labelled rows to learn from are read before. Texts that are null or
    empty get scores like any others; no other column of docs is an input.
    """
    docs = docs.select("doc_id", "text")
    scored = add_scores(docs, fit_quality(docs, labels, fit_rows))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs, whole and unchanged, that the classifier does not reject (score 0.5 or more)."""
    model = fit_quality(docs.select("doc_id", "text"), labels, fit_rows)
    away, back = shielded(docs, ("_score",))
    return back(add_scores(away, model, out_col="_score").where(F.col("_score") >= 0.5))
