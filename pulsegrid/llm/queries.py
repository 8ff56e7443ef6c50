"""The registered queries of the corpus operators, with their production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.bpe_codec import bpe_encode
from pulsegrid.llm.common import read_table, utf8
from pulsegrid.llm.mixing import mixed
from pulsegrid.llm.near_dedup import near_classes
from pulsegrid.llm.period_runs import period_runs
from pulsegrid.llm.quality import quality_scores
from pulsegrid.llm.recompression import recompression_dedup
from pulsegrid.llm.secret_scan import ADDED, BASE, Rule, secret_spans, spans_text
from pulsegrid.llm.sharding import shard_rows
from pulsegrid.llm.suffix_dedup import suffix_dedup
from pulsegrid.llm.tiff import tiff_encode, tiff_pages
from pulsegrid.llm.token_counts import token_counts
from pulsegrid.llm.turn_repair import repair_report, repair_turns
from pulsegrid.llm.vector_search import top_k

TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 512
SHARDS, ROW_BYTES, SEED = 40, 16, 2024


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_classes(docs).select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("is_first"))


OP1_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
reps AS (SELECT t, min(doc_id) AS rep, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d GROUP BY t),
s AS (SELECT rep, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' '))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS run FROM reps),
c AS (SELECT rep, run, count(*) AS n FROM s GROUP BY rep, run),
z AS (SELECT rep, sum(n) AS total FROM c GROUP BY rep),
o AS (SELECT a.rep AS a, b.rep AS b, sum(least(a.n, b.n)) AS shared FROM c a JOIN c b ON a.run = b.run AND a.rep < b.rep GROUP BY a.rep, b.rep),
e AS (SELECT a, b FROM o JOIN z za ON za.rep = a JOIN z zb ON zb.rep = b WHERE shared >= 0.8 * (za.total + zb.total - shared)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT rep AS node, rep AS root FROM reps UNION SELECT r.node, l.b AS root FROM r JOIN l ON l.a = r.root),
k AS (SELECT node, min(root) AS class_id FROM r GROUP BY node)
SELECT d.doc_id, k.class_id, d.doc_id = k.class_id AS is_first FROM d JOIN reps USING (t) JOIN k ON k.node = reps.rep
"""


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = utf8(F.col("text"))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(raw).cast("long") + ROW_BYTES).alias("size"), F.crc32(raw).alias("text_crc32"))
    placed = shard_rows(docs, SHARDS, seed=SEED)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", utf8(F.col("text")).alias("payload"))
    stored = tiff_encode(docs, "payload").select("doc_id", F.octet_length("payload").cast("long").alias("n_bytes"), "media")
    return tiff_pages(stored).select(
        "doc_id", "n_bytes", F.octet_length("pixels").cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"), F.crc32(F.expr("substring(pixels, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )  # fmt: skip


def op4_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return recompression_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 18, 1))) AS s FROM d),
k AS (SELECT doc_id, s, array_to_string(list_slice(ws, s, s + 19), ' ') AS words FROM w),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY words ORDER BY doc_id, s) AS nth FROM k),
g AS (SELECT DISTINCT doc_id, s + i AS pos FROM f, range(0, 20) t(i) WHERE nth > 1),
x AS (SELECT doc_id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS word FROM d),
y AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM x ANTI JOIN g USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN y USING (doc_id)
"""


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts(docs, public_tokenizers.path(TOKENIZER))
    return counted.select("doc_id", F.octet_length(utf8(F.col("text"))).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    columns = {"_topic": "topic", "_tokens": "tokens", "_weight": "weight", "_probability": "probability", "_kept": "kept"}
    return mixed(docs).select("doc_id", "source", "lang", *[F.col(a).alias(b) for a, b in columns.items()])


def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, 5, F.col("vec_id") % 50 == 0, scale=256.0)


OP8_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.place, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.place <> q.place AND len(c.e) = len(q.e)
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) <= 5
"""


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_encode(docs, public_tokenizers.path(TOKENIZER), decoded_col="decoded")
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 99, 0))) AS s FROM b),
k AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 200)) AS piece FROM w),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY piece ORDER BY doc_id, s) AS nth FROM k),
r AS (SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 1 ELSE 0 END AS new FROM f WHERE nth > 1),
i AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM r),
j AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS e FROM i GROUP BY doc_id, island),
p AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS low, a AS top FROM j
  UNION ALL SELECT doc_id, coalesce(max(e), 0) AS low, any_value(len(h) // 2) AS top FROM b LEFT JOIN j USING (doc_id) GROUP BY doc_id),
y AS (SELECT doc_id, string_agg(substr(h, 2 * low + 1, 2 * (top - low)), '' ORDER BY low) AS kept FROM p JOIN b USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, CAST(sum(e - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM j GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM b JOIN y USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def damaged_turns(rows: DataFrame) -> DataFrame:
    """conversations with faults put in by a hash of conversation and turn: rows dropped, emptied, without an end, repeated, of another role."""
    space = F.lit(" ")
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    place = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    h = F.crc32(place.cast("binary")) % 20
    copies = F.when(h == 0, 0).when(h == 3, 2).otherwise(1)
    made = rows.select(
        "conv_id", "turn", F.when(h == 4, "user").otherwise(role).alias("role"),
        F.when(h == 1, "").when(h == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), F.explode(F.array_repeat(F.lit(1), copies)).alias("copy"),
    )  # fmt: skip
    return made.drop("copy")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    report = repair_report(repair_turns(damaged_turns(rows)))
    every = rows.select("conv_id").distinct().join(report, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text in SQL: bytes are mixed in, each followed by eight shifts."""
    steps = f"list_concat([4294967295], flatten(list_transform(string_split({text}, ''), lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])))"
    return f"xor(list_reduce({steps}, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"


def turn_repair_sql() -> str:
    """Row after row in a recursion: the cheapest way (cost c, letters a, turns r) to each state; the least of equally cheap letters."""

    def way(q: str, cost: str, letter: str, item: str = "") -> str:
        return f"CASE WHEN {q} IS NOT NULL THEN {{'c': {q}.c + {cost}, 'a': {q}.a || '{letter}', 'r': " + (f"list_append({q}.r, {item})" if item else f"{q}.r") + "} END"

    def best(*ways: str) -> str:
        return f"list_sort(list_filter([{', '.join(ways)}], lambda z: z IS NOT NULL))[1]"

    def row(q: str, letter: str) -> str:
        """The row kept, or given the role of a letter."""
        kept = f"CASE WHEN x = '{letter}' THEN " + way(q, "t", "K", "role || ':' || text") + " END"
        if letter == "s":
            return f"CASE WHEN NOT gone THEN {kept} END"
        name = {"u": "user", "a": "assistant"}[letter]
        return f"CASE WHEN NOT gone THEN {best(kept, way(q, '2 + t', 'R', f"'{name}:' || text"))} END"

    start = "{'c': CAST(0 AS BIGINT), 'a': CAST('' AS VARCHAR), 'r': CAST([] AS VARCHAR[])}"
    put_in = "p0 AS q0, p1 AS q1, " + best("p2", way("p0", "2", "I", "'user:'"), way("p1", "2", "I", "'user:'"), way("p3", "2", "I", "'user:'")) + " AS q2, p3"
    last = f"q0, q1, q2, {best('p3', way('q2', '2', 'I', "'assistant:'"))} AS q3"
    step = ", ".join([way("q0", "3", "D") + " AS p0", best(way("q1", "3", "D"), row("q0", "s")) + " AS p1", best(way("q2", "3", "D"), *[row(q, "u") for q in ("q0", "q1", "q3")]) + " AS p2", best(way("q3", "3", "D"), row("q2", "a")) + " AS p3"])
    pairs = "lag(x) OVER w IS NOT NULL AND lag(x) OVER w || x NOT IN ('su', 'ua', 'au')"
    return (
        "WITH RECURSIVE b AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS k, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, "
        + crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
        + r""" % 20 AS h FROM conversations),
d AS (SELECT k, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM b),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS x FROM d),
m AS (SELECT *, NOT regexp_matches(text, '[^ 	-]') AS blank, row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][ 	-]*\z') AS cut,
  """ + pairs + r""" AS bad FROM n WINDOW w AS (PARTITION BY k ORDER BY i)),
r AS (SELECT *, blank OR again AS gone, CAST(NOT blank AND NOT again AND cut AS BIGINT) AS t FROM m),
v AS (SELECT k, CAST(0 AS BIGINT) AS i, """ + last + f" FROM (SELECT k, {put_in} FROM (SELECT DISTINCT k, {start} AS p0, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR[])) AS p1, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR[])) AS p2, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR[])) AS p3 FROM r))"
        + f" UNION ALL SELECT k, i, {last} FROM (SELECT k, i, {put_in} FROM (SELECT v.k, r.i, {step} FROM v JOIN r ON r.k = v.k AND r.i = v.i + 1))),"
        + f"""
g AS (SELECT k, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate, CAST(sum(t) AS BIGINT) AS truncated, count(*) FILTER (WHERE bad) AS illegal FROM r GROUP BY k),
f AS (SELECT g.*, {best('q0', 'q3')} AS z FROM g JOIN v ON v.k = g.k AND v.i = g.n)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(z.c, 0) AS cost, coalesce(z.a, '') AS audit,
  sha256(coalesce(array_to_string(z.r, chr(10)), '')) AS repaired_sha256 FROM (SELECT DISTINCT k, conv_id FROM b) LEFT JOIN f USING (k)"""
    )


OP11_SQL = turn_repair_sql()


def repeated_tails(docs: DataFrame) -> DataFrame:
    """documents in which every tenth text, by a hash of its id, repeats its words from some place on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    picked = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), F.expr("crc32(cast(cast(doc_id as string) as binary)) div 10").alias("g"))
    n = F.size("words").cast("long")
    placed = picked.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.when(F.col("n") > 0, F.col("n"))))
    placed = placed.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - F.col("a") - 1), lambda k: F.get("words", (F.col("a") + k % F.col("p")).cast("int")))
    made = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), tail), " ")
    return placed.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def op12_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = period_runs(repeated_tails(read_table(spark, sf_dir, "documents"))).select("doc_id", "runs", F.sha2("collapsed", 256).alias("collapsed_sha256"))
    # runs are in order of start and period: of equal exponents the first one stays
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)  # noqa: E731
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), "collapsed_sha256")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: Ranks by 1, 2, 4, ... words; a period d shows as the distance to the next equal stretch of m words with m / 2 < d <= m.
OP12_SQL = (
    r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, """
    + crc32_sql("CAST(doc_id AS VARCHAR)")
    + r""" AS h FROM documents),
g AS (SELECT *, CAST(len(ws) AS BIGINT) AS n, h // 10 AS g FROM d),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
x AS (SELECT doc, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(0, n), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % p + 1] END) END AS ws FROM p),
y AS (SELECT doc, generate_subscripts(ws, 1) - 1 AS i, unnest(ws) AS word FROM x),
w AS (SELECT doc, i, word, min(i) OVER (PARTITION BY doc, word) AS r FROM y),
v AS (SELECT 1 AS m, doc, i, r FROM w
  UNION ALL SELECT 2 * m, doc, i, min(i) OVER (PARTITION BY doc, r, s) FROM (SELECT m, doc, i, r, lead(r, m) OVER (PARTITION BY doc ORDER BY i) AS s FROM v) WHERE s IS NOT NULL),
c AS (SELECT DISTINCT doc, q FROM (SELECT doc, m, lead(i) OVER (PARTITION BY m, doc, r ORDER BY i) - i AS q FROM v) WHERE q <= m AND 2 * q > m),
e AS (SELECT c.doc, q, s.i, s.i - row_number() OVER (PARTITION BY c.doc, q ORDER BY s.i) AS part FROM c JOIN w s ON s.doc = c.doc JOIN w t ON t.doc = c.doc AND t.i = s.i + q AND t.r = s.r),
f AS (SELECT doc, q, min(i) AS start, count(*) + q AS length FROM e GROUP BY doc, q, part HAVING count(*) >= 3 * q AND count(*) >= 6 - q),
o AS (SELECT doc, start, length, min(q) AS period FROM f GROUP BY doc, start, length),
b AS (SELECT doc, count(*) AS n_runs, arg_min(struct_pack(start := start, length := length, period := period), (-(CAST(length AS HUGEINT) * 1000000000000 // period), start, period)) AS best,
  string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM o GROUP BY doc),
z AS (SELECT DISTINCT doc, unnest(range(start + period, start + length)) AS i FROM o),
k AS (SELECT doc, string_agg(word, ' ' ORDER BY i) AS kept FROM w ANTI JOIN z USING (doc, i) GROUP BY doc)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.start AS BIGINT) AS start, CAST(best.length AS BIGINT) AS length, CAST(best.period AS BIGINT) AS period, CAST(1000 * best.length // best.period AS BIGINT) AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (doc) LEFT JOIN k USING (doc)"""
)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = secret_spans(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = lambda kinds: F.filter("spans", lambda s: s["kind"].isin(kinds))  # noqa: E731
    counts = [F.size(kept([r.kind])).cast("long").alias(f"n_{r.kind}") for r in BASE]
    base = kept([r.kind for r in BASE])
    return docs.select("doc_id", *counts, F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def sql_of_rule(i: int, rule: Rule) -> str:
    """Places of a rule's matches in SQL: pieces between matches and the matches themselves, their lengths added up."""
    pattern = rule.pattern.replace("'", "''")
    return f"""p{i} AS (SELECT doc, string_split_regex(t, '{pattern}') AS ps, regexp_extract_all(t, '{pattern}') AS fs, regexp_extract_all(t, '{pattern}', {rule.group}) AS gs FROM d),
u{i} AS (SELECT doc, generate_subscripts(fs, 1) AS k, unnest(list_transform(fs, lambda x: length(x))) AS size, unnest(list_transform(gs, lambda x: length(x))) AS measured, unnest(list_transform(ps[:len(fs)], lambda x: length(x))) AS gap FROM p{i} WHERE len(fs) > 0),
s{i} AS (SELECT doc, {i} AS rule, '{rule.kind}' AS kind, measured, CAST(sum(gap + size) OVER (PARTITION BY doc ORDER BY k) AS BIGINT) AS e, size FROM u{i})"""


OP13_SQL = (
    "WITH d AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS t FROM documents), "
    + ", ".join(sql_of_rule(i, r) for i, r in enumerate(BASE + ADDED))
    + ", x AS ("
    + " UNION ALL ".join(f"SELECT doc, rule, kind, e - size AS s, e FROM s{i} WHERE measured >= {r.least}" for i, r in enumerate(BASE + ADDED))
    + f"""), g AS (SELECT doc, {", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE)},
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rule) FILTER (WHERE rule < {len(BASE)}) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rule) AS spans FROM x GROUP BY doc)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc)"""
)


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_sharding": op2_sharding,
    "op3_tiff_media": op3_tiff_media,
    "op4_recompression_dedup": op4_recompression_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_mixing": op7_mixing,
    "op8_vector_search": op8_vector_search,
    "op9_bpe_codec": op9_bpe_codec,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_turn_repair": op11_turn_repair,
    "op12_period_runs": op12_period_runs,
    "op13_secret_scan": op13_secret_scan,
}

#: Queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op1_near_dedup": OP1_SQL, "op4_recompression_dedup": OP4_SQL, "op8_vector_search": OP8_SQL, "op10_suffix_dedup": OP10_SQL, "op11_turn_repair": OP11_SQL, "op12_period_runs": OP12_SQL, "op13_secret_scan": OP13_SQL}
