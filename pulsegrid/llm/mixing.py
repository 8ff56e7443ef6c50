"""Mixing sources to target weights by iterative proportional fitting.

Tokens are added up by cell (source, language, topic). Raking multiplies the cells by one factor per source,
language and topic in turn until the marginal shares are the targets. A document is then kept with the
probability that its cell's factor gives, scaled so that the expected tokens are the asked share of all.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import add_columns, drop_table, shielded, tune, without, write_table

MARGINS = ("source", "lang", "topic")


@dataclass(frozen=True)
class Mix:
    """Targets and limits of a mix.

    powers: by margin, the target share of a category is in proportion to its tokens ** power: 1 leaves a margin
    as it is, 0 makes it even. targets: by margin, explicit shares instead, adding up to 1; a category without
    one goes. budget: expected share of all tokens that is kept. cycles: rakings of all
    margins at most; they end before once every marginal share is within tolerance of its target.
    """

    powers: dict[str, float] = field(default_factory=dict)
    targets: dict[str, dict[str, float]] = field(default_factory=dict)
    budget: float = 0.5
    cycles: int = 30
    tolerance: float = 1e-6
    seed: int = 2024


#: Columns that mixed() uses.
NAMES = ("_topic", "_tokens", "_weight", "_probability", "_kept", "_cell", "_draw")

#: The production mix: sources flattened strongly, languages and topics mildly.
MIX = Mix(powers={"source": 0.5, "lang": 0.7, "topic": 0.7})


#: Topics by their order of precedence after "empty", the characters that make them, and the share of
#: a text's characters above which they hold. A text that none fits is prose.
TOPICS = (("table", b"|", 0.02), ("numeric", b"0123456789", 0.03), ("symbols", b"#$%&*+<=>@^_~{}[]!", 0.05), ("lines", b"\n", 0.012))
_marks = np.zeros((256, len(TOPICS) + 1))
for _k, (_, _bytes, _) in enumerate(TOPICS):
    _marks[list(_bytes), _k] = 1
_marks[128:192, -1] = 1  # bytes that go on with a character


def topics_and_tokens(texts: list[bytes]) -> tuple[list[str], list[int]]:
    """What each text is about, by its form, from one histogram of its bytes; and its words."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = np.stack([np.bincount(np.frombuffer(t, np.uint8), minlength=256) for t in texts]) @ _marks
    share = counts[:, :-1] / np.maximum(sizes - counts[:, -1], 1)[:, None]
    fits = np.c_[sizes == 0, share > [most for _, _, most in TOPICS], np.ones(len(texts), bool)]
    names = ["empty", *[name for name, _, _ in TOPICS], "prose"]
    return [names[k] for k in fits.argmax(1).tolist()], [len(t.split()) for t in texts]


def described(docs: DataFrame, seed: int) -> DataFrame:
    """docs with _topic, _tokens and _draw, in one narrow pass over the texts."""
    tune(docs.sparkSession)

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            names, words = topics_and_tokens([x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()])
            return [pa.array(names, pa.string()), pa.array(words, pa.int64())]

        return work

    fields = [T.StructField("_topic", T.StringType(), False), T.StructField("_tokens", T.LongType(), False)]
    return add_columns(docs.drop(*NAMES).withColumn("_draw", draw(F.col("doc_id"), F.col("text"), seed)), ["text"], fields, make)


def cells_of(docs: DataFrame) -> DataFrame:
    """Tokens and documents by cell; docs has the MARGINS and tokens. One partial aggregation before its shuffle."""
    return docs.groupBy(*MARGINS).agg(F.sum("tokens").cast("double").alias("tokens"), F.count(F.lit(1)).alias("docs"))


def target_shares(cells: DataFrame, margin: str, mix: Mix) -> DataFrame:
    """Target share of each category of a margin; categories without tokens have none, and the others add up to 1."""
    power, given = mix.powers.get(margin, 1.0), mix.targets.get(margin)
    if given:
        shares = cells.sparkSession.createDataFrame(list(given.items()), f"{margin} string, _t double")
        sums = shares.join(cells.where("tokens > 0").select(margin).distinct(), margin)
        other = cells.select(margin).distinct().join(shares.select(margin), margin, "left_anti").select(margin, F.lit(0.0).alias("_t"))
        sums = sums.unionByName(other)
    else:
        sums = power_of_sums(cells, margin, power)
    return sums.crossJoin(F.broadcast(sums.agg(F.sum("_t").alias("_all")))).select(margin, (F.col("_t") / F.col("_all")).alias("target"))


def power_of_sums(cells: DataFrame, margin: str, power: float) -> DataFrame:
    return cells.groupBy(margin).agg(F.sum("tokens").alias("_t")).where("_t > 0").withColumn("_t", F.pow("_t", F.lit(float(power))))


def same(left: DataFrame, right: DataFrame, margin: str, how: str = "inner") -> DataFrame:
    """A join on one margin at which null is a category of its own."""
    return left.join(right.withColumnRenamed(margin, "_key"), F.col(margin).eqNullSafe(F.col("_key")), how).drop("_key")


def rake(cells: DataFrame, mix: Mix = MIX) -> DataFrame:
    """The MARGINS, tokens, docs and weight of each cell: the factor of its tokens in the mix, 1 on average.

    cells is one row per cell, as cells_of gives it. Cells without tokens get weight 0. Every step is a join with the
    sums of one margin, after which the table of cells is written, so that the plan does not grow with the cycles.
    """
    fitted = write_table(cells.withColumn("weight", F.when(F.col("tokens") > 0, 1.0).otherwise(0.0)), "cells")
    total = float(fitted.agg(F.sum("tokens")).first()[0] or 0.0)
    if not total:
        return fitted
    first, columns = fitted, fitted.columns
    for m in MARGINS:
        fitted = same(fitted, target_shares(first, m, mix).withColumnRenamed("target", f"_goal_{m}"), m, "left")
    fitted = write_table(fitted, "cells")
    drop_table(first)
    for _ in range(mix.cycles):
        worst = 0.0
        for m in MARGINS:
            sums = fitted.groupBy(m).agg((F.sum(F.col("tokens") * F.col("weight")) / F.lit(total)).alias("_share"))
            goal, share, seen, before = F.col(f"_goal_{m}"), F.col("_share"), Observation(), fitted
            step = same(fitted, sums, m).observe(seen, F.max(F.abs(goal - share)).alias("off"))
            weight = F.when((share > 0) & goal.isNotNull(), F.col("weight") * goal / share).otherwise(F.col("weight"))
            fitted = write_table(step.withColumn("weight", weight).drop("_share"), "cells")
            drop_table(before)
            worst = max(worst, seen.get["off"] or 0.0)
        if worst < mix.tolerance:
            break
    return without(fitted, [c for c in fitted.columns if c not in columns])


def calibrate(cells: DataFrame, budget: float) -> DataFrame:
    """cells with probability: least of 1 and scale * weight, with the scale at which the expected tokens are the budget.

    Cells by falling weight: once the heaviest ones are at 1, the scale is what is left of the budget over what is
    left of the weighted tokens. Every candidate scale comes from sums over the distinct weights, so a search for
    the right one is a few aggregations of the table of cells.
    """
    total, heaviest = cells.agg(F.sum("tokens"), F.max("weight")).first()
    if not total or not heaviest:
        return cells.withColumn("probability", F.lit(0.0))
    want = budget * total
    scale = budget
    for _ in range(60):
        full, rest = cells.agg(
            F.sum(F.when(F.col("weight") * scale >= 1, F.col("tokens")).otherwise(0.0)),
            F.sum(F.when(F.col("weight") * scale < 1, F.col("tokens") * F.col("weight")).otherwise(0.0)),
        ).first()
        if full + rest * scale >= want * (1 - 1e-12) or rest == 0:
            break
        scale = (want - full) / rest
    return cells.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * F.lit(float(scale))))


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A number from 0 to below 1 that id, text and seed decide; 53 bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, text), 11) / F.lit(float(2**53))


def weighed(rows: DataFrame, mix: Mix = MIX) -> DataFrame:
    """rows of described() with _weight, _probability and _kept; the cells' sums are taken over these very rows."""
    narrow = rows.select("source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("tokens"))
    fitted = rake(cells_of(narrow), mix)
    cells = write_table(calibrate(fitted, mix.budget), "cells")
    drop_table(fitted)
    key = lambda columns: F.struct(*[F.coalesce(c, F.lit("")).alias(m) for m, c in columns.items()], *[c.isNull().alias(f"no_{m}") for m, c in columns.items()])
    cells = cells.select(key({m: F.col(m) for m in MARGINS}).alias("_cell"), F.col("weight").alias("_weight"), F.col("probability").alias("_probability"))
    joined = rows.withColumn("_cell", key({"source": F.col("source"), "lang": F.col("lang"), "topic": F.col("_topic")})).join(cells, "_cell", "left").drop("_cell")
    chance = F.when(F.col("_tokens") == 0, F.lit(float(mix.budget))).otherwise(F.coalesce("_probability", F.lit(0.0)))
    return joined.withColumn("_probability", chance).withColumn("_kept", F.col("_draw") < F.col("_probability")).drop("_draw")


def mixed(docs: DataFrame, mix: Mix = MIX) -> DataFrame:
    """Every row of docs but for its text, with _topic, _tokens, _weight, _probability and _kept.

    docs has doc_id, text, source and lang. Null sources and languages are categories of their own; null and
    empty texts have topic "empty" and no tokens, and as they weigh nothing in any margin they are kept with
    the budget's probability. Repeated rows share one draw, so all or none of them are kept. An empty table
    gives an empty table. Texts are read once: their topics, tokens and draws are written to the shared folder, from
    which come both the cells and the answer. Only sums come to the driver; Spark broadcasts the table of cells only by
    its measured size.
    """
    return weighed(write_table(described(docs, mix.seed).drop("text"), "described"), mix)


def margin_shares(rows: DataFrame, mix: Mix = MIX) -> DataFrame:
    """margin, category, target, raked and expected: shares of the tokens that were asked for, that the weights give, and
    that the sample is expected to have. rows as mixed() gives them.

    A cell's probability ends at 1, so where a target asks for more tokens than there are, expected stays below it.
    """
    narrow = rows.select("source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").cast("double").alias("tokens"), (F.col("_tokens") * F.col("_weight")).alias("_w"), (F.col("_tokens") * F.col("_probability")).alias("_p"))
    cells = write_table(narrow.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"), F.sum("_w").alias("_w"), F.sum("_p").alias("_p")), "shares")
    total, out = cells.agg(F.sum("_w").alias("_all_w"), F.sum("_p").alias("_all_p")), None
    for m in MARGINS:
        sums = same(cells.groupBy(m).agg(F.sum("_w").alias("_w"), F.sum("_p").alias("_p")), target_shares(cells, m, mix), m).crossJoin(F.broadcast(total))
        part = sums.select(F.lit(m).alias("margin"), F.col(m).cast("string").alias("category"), "target", (F.col("_w") / F.col("_all_w")).alias("raked"), (F.col("_p") / F.col("_all_p")).alias("expected"))
        out = part if out is None else out.unionAll(part)
    return out


def sample_mix(docs: DataFrame, mix: Mix = MIX) -> DataFrame:
    """The rows of docs that the mix keeps, whole and unchanged."""
    away, back = shielded(docs, NAMES)
    return back(weighed(described(away, mix.seed), mix).where("_kept"))
