"""Secrets in texts: a trigram inverted index picks the texts that a rule's regular expression is run over.

Only DataFrame functions work on the data; what runs in Python is the reading of the rules, once, on the driver.

From each expression a Boolean query over trigrams follows: what every match must contain. The index holds the postings
of these trigrams over texts in lower case: (trigram, block, keys), where a block is a bounded share of the rows, so
that the list of a frequent trigram is many rows. Postings are intersected and united inside each block, and only the
candidates are verified. A rule from which no trigram follows is verified on every text.

A null text is empty; a row's id may be null or repeated. The key of a row is a hash of its id and text: rows that share
one share their candidates, which verification then tells apart, so results never depend on it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import quoted


@dataclass(frozen=True)
class Rule:
    """Matches of pattern, leftmost and not overlapping; those whose group has fewer than least characters are dropped.

    pattern must mean the same to Python's parser and to Java: classes, groups, alternatives and repeats.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def either(words: str) -> str:
    """words (an expression over small letters) with every letter in either case."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


# The base kinds, then those that are added.
BASE = [
    Rule("assign", "(" + either("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]{32,}"),
]
ADDED = [
    Rule("pem", "-----BEGIN ([A-Z]+ ){0,4}PRIVATE KEY-----"),
    Rule("github", "gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}"),
    Rule("url", "[A-Za-z][A-Za-z0-9+.-]{0,20}://[A-Za-z0-9._~%+-]+:[A-Za-z0-9._~%!*+-]+@"),
]

#: Strings that a part of an expression may stand for before it counts as anything.
STRINGS = 64
#: Rows of a block of the index, on average.
BLOCK_ROWS = 2048

Clause = frozenset[frozenset[str]]


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def absorbed(ways: set[frozenset[str]]) -> Clause:
    """Alternatives, each a set of trigrams that go together, without those that another one covers."""
    return frozenset(w for w in ways if not any(v < w for v in ways))


class Reader:
    """What every match of a part of an expression contains, read from left to right."""

    def __init__(self) -> None:
        self.open: set[str] = {""}
        self.clauses: set[Clause] = set()

    def add(self, strings: set[str] | None) -> None:
        """The next part is one of these strings; None: anything."""
        if strings is not None and len(self.open) * len(strings) <= STRINGS:
            self.open = {a + b for a, b in product(self.open, strings)}
            return
        self.close()
        self.open = strings if strings is not None and len(strings) <= STRINGS else {""}

    def close(self) -> None:
        if min(map(len, self.open)) >= 3:
            self.clauses.add(absorbed({trigrams(s) for s in self.open}))
        self.open = {""}

    def read(self, parts) -> None:
        for kind, value in parts:
            strings = exact([(kind, value)])
            if strings is not None or kind is sre.AT:
                self.add(strings or {""})
            elif kind is sre.SUBPATTERN:
                self.read_apart(value[3])
            elif kind is sre.MAX_REPEAT and value[0] >= 1:
                self.read_apart(value[2])
            elif kind is sre.BRANCH:
                self.add(None)
                self.branch(value[1])
            else:
                self.add(None)

    def read_apart(self, parts) -> None:
        """Parts that are there at least once, with anything around them."""
        self.add(None)
        self.read(parts)
        self.add(None)

    def branch(self, branches) -> None:
        ways: set[frozenset[str]] = set()
        for parts in branches:
            clauses = query_of(parts)
            if not clauses:
                return
            ways |= {frozenset().union(*pick) for pick in product(*clauses)}
        self.clauses.add(absorbed(ways))


def exact(parts) -> set[str] | None:
    """All strings, in small letters, that the parts match; None if they are many or without end."""
    out = {""}
    for kind, value in parts:
        if kind is sre.LITERAL:
            found = {chr(value).lower()}
        elif kind is sre.IN:
            found = characters(value)
        elif kind is sre.SUBPATTERN:
            found = exact(value[3])
        elif kind is sre.BRANCH:
            each = [exact(p) for p in value[1]]
            found = None if None in each else set().union(*each)
        elif kind is sre.MAX_REPEAT and value[1] <= 4:
            one = exact(value[2])
            found = None if one is None else {"".join(x) for n in range(value[0], value[1] + 1) for x in product(one, repeat=n)}
        else:
            found = None
        if found is None or len(out) * len(found) > STRINGS:
            return None
        out = {a + b for a, b in product(out, found)}
    return out


def characters(items) -> set[str] | None:
    out: set[str] = set()
    for kind, value in items:
        if kind is sre.LITERAL:
            out.add(chr(value).lower())
        elif kind is sre.RANGE and value[1] - value[0] < 8:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out


def query_of(parts) -> set[Clause]:
    reader = Reader()
    reader.read(parts)
    reader.close()
    return reader.clauses


def trigram_query(pattern: str) -> list[Clause]:
    """Clauses that all hold for the lower case of a text with a match: of one of a clause's sets all trigrams are there.

    An empty list: nothing follows from the expression.
    """
    return sorted(query_of(parser.parse(pattern)), key=lambda c: sorted(map(sorted, c)))


def vocabulary(rules: list[Rule]) -> list[str]:
    return sorted({t for r in rules for clause in trigram_query(r.pattern) for way in clause for t in way})


def trigram_index(keyed: DataFrame, grams: list[str], blocks: int) -> DataFrame:
    """trigram, block and keys: the postings of the trigrams over keyed (key, text).

    Each text is put in lower case once and searched for each trigram; sets are made before the shuffle and after it.
    """
    folded = keyed.select("key", F.lower("text").alias("folded"))
    found = F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(g)), F.lit(g)) for g in grams]))
    posted = folded.select("key", F.explode(found).alias("trigram"))
    return posted.groupBy("trigram", F.pmod(F.col("key"), F.lit(blocks)).alias("block")).agg(F.collect_set("key").alias("keys"))


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """key and kinds: the rules with trigrams whose query a row's postings satisfy."""
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("postings"))
    none = F.array().cast("array<bigint>")

    def posting(gram: str) -> Column:
        return F.coalesce(F.try_element_at("postings", F.lit(gram)), none)

    def way(grams: frozenset[str]) -> Column:
        return reduce(F.array_intersect, [posting(g) for g in sorted(grams)])

    def clause(ways: Clause) -> Column:
        return reduce(F.array_union, [way(w) for w in sorted(ways, key=sorted)])

    found = [F.struct(F.lit(r.kind).alias("kind"), reduce(F.array_intersect, [clause(c) for c in q]).alias("keys")) for r in rules if (q := trigram_query(r.pattern))]
    pairs = lists.select(F.explode(F.array(*found)).alias("f")).select("f.kind", F.explode("f.keys").alias("key"))
    return pairs.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def running(x: Column, block: int = 256) -> Column:
    """The sums of what stands before each number of an array that is not empty, by blocks, so that work is not quadratic."""

    def sums(part: Column, first: Column) -> Column:
        grown = F.aggregate(part, F.array(first), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))
        return F.slice(grown, F.lit(1), F.size(part))

    parts = F.transform(F.sequence(F.lit(1), F.size(x), F.lit(block)), lambda i: F.slice(x, i, F.lit(block)))
    totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda a, v: a + v))
    return F.flatten(F.zip_with(parts, sums(totals, F.lit(0).cast("long")), sums))


def secret_spans(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text", out_col: str = "spans") -> DataFrame:
    """docs with out_col: an array of kind, start and end (code points, end exclusive) by start, then rule as listed.

    rules: BASE and ADDED unless given. Every row comes back once, with all its columns, which may have any names; a
    column out_col is replaced. Only keys of the index and candidates move beside the one shuffle of the rows.
    """
    rules = BASE + ADDED if rules is None else rules
    kept = [c for c in docs.columns if c != out_col]
    row = F.struct(*[quoted(c).alias(c) for c in kept if c != text_col])
    text = F.coalesce("t", F.lit(""))
    keyed = docs.select(row.alias("row"), quoted(text_col).alias("t")).withColumn("key", F.xxhash64(F.col("row").getField(id_col), text))
    grams = vocabulary(rules)
    if grams:
        index = trigram_index(keyed.select("key", text.alias("text")), grams, max(1, -(-docs.count() // BLOCK_ROWS)))
        picked = keyed.join(candidates(index, rules), "key", "left")
    else:
        picked = keyed.withColumn("kinds", F.array().cast("array<string>"))
    parts = []
    for i, r in enumerate(rules):
        hit = F.rlike(text, F.lit(r.pattern))
        hit = F.array_contains("kinds", r.kind) & hit if trigram_query(r.pattern) else hit
        each = {"p": F.split(text, r.pattern, -1), "f": F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0)), "g": F.regexp_extract_all(text, F.lit(r.pattern), F.lit(r.group))}
        parts += [F.when(hit, c).alias(f"{n}{i}") for n, c in each.items()]
    made = picked.select("row", "t", *parts)
    spans = [F.coalesce(placed(i, r), F.array().cast(SPANS)) for i, r in enumerate(rules)]
    joined = made.select("row", "t", F.array_sort(F.concat(*spans)).alias("all"))
    named = F.transform("all", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return joined.select(*[(F.col("t") if c == text_col else F.col("row").getField(c)).alias(c) for c in kept], named.alias(out_col))


SPANS = "array<struct<start:bigint,rule:int,kind:string,end:bigint>>"


def placed(i: int, rule: Rule) -> Column:
    """The spans of a rule, from the pieces between its matches (p), the matches (f) and their measured groups (g); null where it has none."""
    pieces, found, group = (F.col(f"{x}{i}") for x in "pfg")
    sizes = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda a, b: F.struct(F.length(a).cast("long").alias("gap"), F.length(b).cast("long").alias("size")))
    starts = F.zip_with(sizes, running(F.transform(sizes, lambda s: s["gap"] + s["size"])), lambda s, at: F.struct((at + s["gap"]).alias("start"), s["size"].alias("size")))
    span = lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("rule"), F.lit(rule.kind).alias("kind"), (s["start"] + s["size"]).alias("end"))
    return F.array_compact(F.zip_with(starts, group, lambda s, g: F.when(F.length(g) >= rule.least, span(s))))


def spans_text(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
