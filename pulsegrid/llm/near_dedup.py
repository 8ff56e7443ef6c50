"""Near-duplicate classes: BagMinHash signatures, banding, and verification of the multiset overlap.

A document is the multiset of its five-word runs, weighted by their counts. Every run has Poisson processes over
the discretised weights: unit weights are the leaves of dyadic blocks (0, 1], (1, 2], (2, 4], (4, 8] and so on. A
block's first point is drawn at its whole rate; the point falls in either half, the other half's first point is
drawn after it, and so on down to the unit weights, whose points hit signature slots. Points later than the
latest slot end a branch, so that few are ever made. A slot keeps its earliest point, and two documents agree in
a slot with the probability of their weighted Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import Fields, add_columns, batch_of, ddl, drop_table, free_shuffles, giving_back, quoted, shielded, tune, write_table
from pulsegrid.llm.components import components
from pulsegrid.llm.hashing import GOLDEN, chunked, mix, shingles

WORDS, SIMILARITY = 5, 0.8
#: Bands of rows: two texts at the similarity miss all of them with a probability of 3 in a million.
BANDS, ROWS = 24, 4
SLOTS = BANDS * ROWS
#: Members of a bucket that are compared at a time, and the share of equal slots from which a pair is verified:
#: a pair at the similarity falls below it with a probability under 1e-5.
MEET, LIKELY = 512, 0.62
#: Bytes of packed multisets that are meant for one part, where they meet.
MEET_BYTES = 16 << 20


def uniform(x: np.ndarray) -> np.ndarray:
    """From hashes to numbers over 0 and up to 1."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def seeded(seed: np.ndarray, what: int, turn: np.ndarray | int = 0) -> np.ndarray:
    return mix(seed + np.uint64(what * int(GOLDEN) & 2**64 - 1) + np.asarray(turn, np.uint64) * np.uint64(0xD1342543DE82EF95))


def bag_minhash(doc: np.ndarray, element: np.ndarray, count: np.ndarray, docs: int, slots: int = SLOTS) -> np.ndarray:
    """docs x slots earliest times; infinite for a document without elements."""
    sig = np.full(docs * slots, np.inf)
    parts = []
    for block in range(int(count.max(initial=1)).bit_length() + 1):
        low = (1 << block) >> 1
        has = np.flatnonzero(count > low)
        if not len(has):
            break
        width = max(1, low)
        seed = seeded(element[has], 1, block)
        parts.append((doc[has], seed, np.full(len(has), low), np.full(len(has), width), count[has], -np.log(uniform(seeded(seed, 2))) / width, np.zeros(len(has), np.int64)))
    nodes = [np.concatenate(p) for p in zip(*parts)] if parts else []
    while len(nodes) and len(nodes[0]):
        d, seed, low, width, n, time, turn = nodes
        leaf = width == 1
        np.minimum.at(sig, d[leaf] * slots + (seeded(seed[leaf], 3, turn[leaf]) % np.uint64(slots)).astype(np.int64), time[leaf])
        latest = sig.reshape(docs, slots).max(1)
        turn = turn[leaf] + 1
        again = [d[leaf], seed[leaf], low[leaf], width[leaf], n[leaf], time[leaf] - np.log(uniform(seeded(seed[leaf], 4, turn))), turn]
        out = [again]
        if not leaf.all():
            d, seed, low, width, n, time = (x[~leaf] for x in nodes[:6])
            half = width // 2
            first_left, other = seeded(seed, 5) & np.uint64(1) == 0, time - np.log(uniform(seeded(seed, 6))) / half
            for side in (0, 1):
                out.append([d, seeded(seed, 7 + side), low + side * half, half, n, np.where(first_left == (side == 0), time, other), np.zeros(len(d), np.int64)])
        nodes = [np.concatenate(p) for p in zip(*out)]
        alive = (nodes[5] <= latest[nodes[0]]) & (nodes[2] < nodes[4])
        nodes = [x[alive] for x in nodes]
    return sig.reshape(docs, slots)


def signatures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (BANDS x 64 bits) and slot bytes of each text; a text without words gets bands of its own kind."""
    doc, element, count = shingles(texts, WORDS)
    bits = bag_minhash(doc, element, count, len(texts)).view(np.uint64).reshape(len(texts), BANDS, ROWS)
    bands = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * GOLDEN, (len(texts), BANDS)).copy()
    for k in range(ROWS):
        bands = mix(bands * GOLDEN + bits[:, :, k])
    return bands, (mix(bits.reshape(len(texts), SLOTS)) >> np.uint64(56)).astype(np.uint8)


def packed_bag(texts: list[bytes]) -> list[bytes]:
    """Each text's multiset: 64-bit run hashes, sorted, then their counts."""
    doc, element, count = shingles(texts, WORDS)
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [element[a:b].astype("<u8").tobytes() + count[a:b].astype("<u4").tobytes() for a, b in zip(at, at[1:])]


def unpacked(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(bag) // 12
    return np.frombuffer(bag, "<u8", n), np.frombuffer(bag, "<u4", n, 8 * n).astype(np.int64)


def overlap(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two packed multisets."""
    (ha, ca), (hb, cb) = unpacked(a), unpacked(b)
    place = np.minimum(np.searchsorted(hb, ha), max(len(hb) - 1, 0))
    both = int(np.minimum(ca, cb[place])[hb[place] == ha].sum()) if len(hb) and len(ha) else 0
    whole = int(ca.sum() + cb.sum()) - both
    return both / whole if whole else 1.0


def forests(sig: np.ndarray, likely: float) -> tuple[list[tuple[int, int]], bool]:
    """Pairs of members to verify first: over the likely pairs, two edge-disjoint forests of greatest agreement, and
    a star around the member that agrees most with all others; and whether likely pairs are left."""
    n = len(sig)
    if n == 2:
        return [(0, 1)] if (sig[0] == sig[1]).mean() >= likely else [], False
    equal = np.zeros((n, n), np.int16)
    for k in range(sig.shape[1]):
        equal += sig[:, k][:, None] == sig[:, k][None, :]
    a, b = np.nonzero(np.triu(equal >= likely * sig.shape[1], 1))
    order = np.argsort(-equal[a, b], kind="stable")
    edges, centre = list(zip(a[order].tolist(), b[order].tolist())), int(equal.sum(1, dtype=np.int64).argmax())
    likely_pairs = len(edges)
    out = [(i, j) for i, j in edges if centre in (i, j)]
    for _ in range(2):
        root, rest = list(range(n)), []

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for i, j in edges:
            x, y = find(i), find(j)
            if x == y:
                rest.append((i, j))
            else:
                root[max(x, y)] = min(x, y)
                out.append((i, j))
        edges = rest
    out = list(dict.fromkeys(out))
    return out, len(out) < likely_pairs


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; texts that differ under one key cannot be made on purpose, as they could with MD5."""
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


PAIRS: Fields = {"a": pa.binary(), "b": pa.binary(), "bucket": pa.int64(), "equal": pa.int32()}


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (bucket, part, parts, key, sig) sorted by bucket, part and key: likely pairs (a, b), and of each
    part of a divided bucket the member nearest to the part's most frequent slot values (a, null); and (null, null) of
    the buckets that are divided or in which likely pairs are left."""

    def groups(table: pa.Table) -> Iterator[list]:
        bucket, part, parts = (table.column(c).to_numpy() for c in ("bucket", "part", "parts"))
        keys = table.column("key").to_pylist()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(keys), -1)
        cut = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])])
        for lo, hi in zip(cut.tolist(), np.r_[cut[1:], len(keys)].tolist()):
            first, more = forests(sig[lo:hi], LIKELY) if hi - lo > 1 else ([], False)
            for i, j in first:
                x, y = sorted((keys[lo + i], keys[lo + j]))
                yield [x, y, None, None]
            if more or parts[lo] > 1:
                yield [None, None, int(bucket[lo]), None]
            if parts[lo] > 1:
                usual = np.array([np.bincount(c, minlength=256).argmax() for c in sig[lo:hi].T])
                near = (sig[lo:hi] == usual).sum(1)
                yield [keys[lo + int(near.argmax())], None, int(bucket[lo]), int(near.max())]

    # whole groups go on with each batch; what is held is the last one, which the next batch may go on with
    held: list[pa.RecordBatch] = []
    for batch in batches:
        bucket, part = batch.column("bucket").to_numpy(), batch.column("part").to_numpy()
        cut = np.flatnonzero((bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])) + 1
        if held and len(bucket) and (held[-1].column("bucket")[-1].as_py(), held[-1].column("part")[-1].as_py()) != (bucket[0], part[0]):
            cut = np.r_[0, cut]
        if len(cut):
            held.append(batch.slice(0, cut[-1]))
            yield batch_of(list(groups(pa.Table.from_batches(held))), PAIRS)
            held, batch = [], batch.slice(cut[-1])
        if batch.num_rows:
            held.append(batch)
    if held:
        yield batch_of(list(groups(pa.Table.from_batches(held))), PAIRS)


def groups_of(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """The rows that agree in the columns named, group by group, from batches that are sorted by them."""
    held, last = [], None
    for batch in batches:
        keys, start = list(zip(*(batch.column(c).to_pylist() for c in names))), 0
        for k, key in enumerate(keys):
            if key != last:
                if k > start:
                    held.append(batch.slice(start, k - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], k, key
        if len(keys) > start:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def open_pairs(group: pa.Table) -> tuple[list[int], list[int], list[int]]:
    """Ends of the likely pairs of a group (bucket, left, right, key, root, sig, bands) whose roots differ, most equal
    first, and a number for each row's root. Of the buckets that two members share, only the first band's gives the pair."""
    n, roots = group.num_rows, {}
    root = np.array([roots.setdefault(r, len(roots)) for r in group.column("root").to_pylist()])
    sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(n, -1)
    bands = group.column("bands").combine_chunks().flatten().to_numpy().reshape(n, -1)
    bucket = group.column("bucket")[0].as_py()
    left, right = (np.flatnonzero(group.column(c).to_numpy()) for c in ("left", "right"))
    if len(left) * len(right) <= 4096:
        equal = (sig[left][:, None] == sig[right][None]).sum(2)
    else:
        equal = np.zeros((len(left), len(right)), np.int16)
        for k in range(sig.shape[1]):
            equal += sig[left, k][:, None] == sig[right, k][None, :]
    apart = (equal >= LIKELY * sig.shape[1]) & (root[left][:, None] != root[right][None, :])
    if len(left) == len(right) == n:
        apart = np.triu(apart, 1)
    i, j = np.nonzero(apart)
    order = np.argsort(-equal[i, j], kind="stable")
    i, j = left[i[order]], right[j[order]]
    early, here = np.zeros(len(i), bool), np.zeros(len(i), bool)
    for k in range(bands.shape[1]):
        same = ~early & (bands[i, k] == bands[j, k])
        here |= same & (bands[i, k] == bucket)
        early |= same
    return i[here].tolist(), j[here].tolist(), root.tolist()


GROUP = ["bucket", "lo", "hi"]
MEMBERS: Fields = {"bucket": pa.int64(), "key": pa.binary(), "root": pa.binary()}
LINKS: Fields = {"a": pa.binary(), "b": pa.binary()}


def in_batches(rows: Iterator[list], fields: Fields) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, 4096)):
        yield batch_of(some, fields)


def unjoined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of the groups that have an open pair there."""

    def rows() -> Iterator[list]:
        for group in groups_of(batches, GROUP):
            i, j, _ = open_pairs(group)
            for row in group.select(list(MEMBERS)).take(pa.array(sorted({*i, *j}), pa.int64())).to_pylist():
                yield list(row.values())

    return in_batches(rows(), MEMBERS)


def verify_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between the roots of the groups' open pairs that have the overlap; a pair that earlier ones of its
    group have joined is not looked at."""

    def rows() -> Iterator[list]:
        for group in groups_of(batches, GROUP):
            i, j, root = open_pairs(group)
            names, bags = group.column("root").to_pylist(), group.column("bag").to_pylist() if i else []
            up = list(range(len(names)))

            def find(x: int) -> int:
                while up[x] != x:
                    up[x] = x = up[up[x]]
                return x

            for a, b in zip(i, j):
                x, y = find(root[a]), find(root[b])
                if x != y and overlap(bags[a], bags[b]) >= SIMILARITY:
                    up[max(x, y)] = min(x, y)
                    yield [names[a], names[b]]

    return in_batches(rows(), LINKS)


def dealt_open(members: DataFrame) -> DataFrame:
    """members (bucket, key, root, size) of the buckets with several roots, in a group for each two parts that meet.

    A root with more members than one part holds has parts of its own, which do not meet each other; the other roots
    are dealt whole. Parts have about MEET members or MEET_BYTES.
    """
    parts = lambda n, size: F.ceil(F.greatest(F.col(n) / MEET, F.col(size) / MEET_BYTES)).cast("int")
    roots = members.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_size")).withColumn("_own", parts("_n", "_size"))
    small = F.col("_own") == 1
    whole = roots.groupBy("bucket").agg(F.count(F.lit(1)).alias("_roots"), F.sum(F.when(small, F.col("_n"))).alias("_n"), F.sum(F.when(small, F.col("_size"))).alias("_size"))
    whole = whole.where("_roots > 1").select("bucket", F.coalesce(parts("_n", "_size"), F.lit(1)).alias("_shared"))
    both = roots.select("bucket", "root", "_own").join(whole, "bucket")
    home = F.when(F.col("_own") > 1, F.hex("root")).otherwise("")
    part = F.when(F.col("_own") > 1, F.pmod(F.xxhash64("key"), F.col("_own"))).otherwise(F.pmod(F.xxhash64("root"), F.col("_shared")))
    dealt = members.select("bucket", "key", "root").join(both, ["bucket", "root"]).select("bucket", "key", "root", home.alias("_home"), F.concat_ws(" ", home, part).alias("_part"))
    dealt = write_table(dealt, "open")
    others = dealt.select("bucket", F.col("_home").alias("_home2"), F.col("_part").alias("_part2")).distinct()
    meeting = dealt.join(others, "bucket").where("_home = '' or _home <> _home2")
    lo, hi = F.least("_part", "_part2"), F.greatest("_part", "_part2")
    return meeting.select("bucket", lo.alias("lo"), hi.alias("hi"), (F.col("_part") == lo).alias("left"), (F.col("_part") == hi).alias("right"), "key", "root")


def met_open(dealt: DataFrame, looks: DataFrame) -> DataFrame:
    """Groups for open_pairs, each whole and in turn, with what looks has of every key."""
    return dealt.join(looks, "key").repartition(*GROUP).sortWithinPartitions(*GROUP, "key")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key (16 bytes that the text decides) and class_id of every row of docs.

    Rows are in one class if a chain of links leads from one to the other; a link joins equal texts and texts
    whose multisets of five-word runs have a weighted Jaccard similarity of 0.8 or more (a text of one to four
    words is one run). class_id is the least id of the class, null if all its ids are null. Null texts count as
    empty, and texts without words are linked only to equal ones. Repeated rows share a class; an empty table
    gives an empty table; other columns are ignored.

    Equal texts become one before anything is compared. Members of a bucket are compared MEET at a time, by
    signature, and first give a number of pairs in proportion to the members; members of different parts of a bucket
    meet through the bucket's most typical member, and in other bands. Every pair is verified on whole multisets.
    Then, in each bucket where those links leave several components, every part meets every other and itself, and
    all likely pairs between components are verified where the parts' multisets meet.
    """
    spark = docs.sparkSession
    tune(spark)
    text = F.coalesce(quoted(text_col), F.lit(""))
    source = docs.select(quoted(id_col).cast("long").alias("id"), text.alias("text"), text_key(text).alias("key"))

    def make_signatures():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            parts = [signatures(texts[a:b]) for a, b in chunked(texts)]
            bands, sig = (np.concatenate(p) for p in zip(*parts))
            has_words = np.array([bool(t.split()) for t in texts])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(has_words * BANDS)].astype(np.int32)), pa.array(bands[has_words].reshape(-1).view(np.int64)))
            return [lists, pa.array([s.tobytes() for s in sig], pa.binary())]

        return work

    fields = [T.StructField("bands", T.ArrayType(T.LongType()), False), T.StructField("sig", T.BinaryType(), False)]
    rows = write_table(add_columns(source, ["text"], fields, make_signatures).drop("text"), "signatures")
    least = F.min("id").alias("id")
    nodes = write_table(rows.groupBy("key").agg(least, F.any_value("bands").alias("bands"), F.any_value("sig").alias("sig")), "nodes")
    banded = nodes.select("key", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    parts = F.ceil(F.col("members") / MEET).cast("int")
    members = banded.join(shared, "bucket").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("key", "bucket"), F.col("parts")).cast("int")).drop("members")
    members = write_table(members, "members")
    dealt = members.join(nodes.select("key", "sig"), "key").repartition("bucket", "part").sortWithinPartitions("bucket", "part", "key")
    met = write_table(dealt.select("bucket", "part", "parts", "key", "sig").mapInArrow(lambda it: giving_back(meet(it)), ddl(PAIRS)), "pairs")
    typical = met.where("b is null and a is not null").groupBy("bucket").agg(F.max_by("a", F.struct("equal", "a")).alias("a"))
    stars = members.where("parts > 1").join(typical, "bucket").select(F.least("a", "key").alias("a"), F.greatest("a", "key").alias("b"))
    pairs = write_table(met.where("b is not null").select("a", "b").unionAll(stars.where("a <> b")).distinct(), "pairs")
    free_shuffles(spark)

    def make_bags():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            return [pa.array([x for a, b in chunked(texts) for x in packed_bag(texts[a:b])], pa.binary())]

        return work

    def bags_of(keys: DataFrame) -> DataFrame:
        wanted = nodes.select("key", F.col("id").alias("least_id")).join(keys, "key")
        found = source.join(wanted.withColumnRenamed("key", "node"), (F.col("key") == F.col("node")) & F.col("id").eqNullSafe(F.col("least_id"))).select("key", "text")
        bags = add_columns(found, ["text"], [T.StructField("bag", T.BinaryType(), False)], make_bags).select("key", "bag")
        return write_table(bags.groupBy("key").agg(F.any_value("bag").alias("bag")), "bags")

    made = [nodes, members, met, pairs]
    bags = bags_of(pairs.select(F.col("a").alias("key")).unionAll(pairs.select(F.col("b").alias("key"))).distinct())
    free_shuffles(spark)
    left, right = bags.select(F.col("key").alias("a"), F.col("bag").alias("bag_a")), bags.select(F.col("key").alias("b"), F.col("bag").alias("bag_b"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = pa.array([overlap(x, y) >= SIMILARITY for x, y in zip(batch.column("bag_a").to_pylist(), batch.column("bag_b").to_pylist())], pa.bool_())
            yield batch.select(["a", "b"]).filter(ok)

    links = pairs.join(left, "a").join(right, "b").mapInArrow(verify, "a binary, b binary")
    roots = components(links)
    free_shuffles(spark)
    roots = roots.withColumnRenamed("node", "key")
    rooted = lambda table: table.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = rooted(nodes.select("key", "id"))

    left_open = met.where("a is null").select("bucket").distinct()
    again = dealt_open(rooted(members.join(left_open, "bucket").select("bucket", "key", F.lit(0).alias("size"))))
    looks = nodes.select("key", "sig", "bands")
    unmet = write_table(met_open(again, looks).mapInArrow(lambda it: giving_back(unjoined(it)), ddl(MEMBERS)).distinct(), "unjoined")
    free_shuffles(spark)
    if unmet.head(1):
        rest = unmet.select("key").distinct().join(bags, "key", "left_anti")
        if rest.head(1):
            made.append(bags_of(rest))
            bags = bags.unionAll(made[-1])
        again = dealt_open(unmet.join(bags.select("key", F.length("bag").alias("size")), "key"))
        joined = write_table(met_open(again, looks.join(bags, "key")).mapInArrow(lambda it: giving_back(verify_open(it)), ddl(LINKS)).distinct(), "links")
        made.append(joined)
        further = components(joined).select(F.col("node").alias("root"), F.col("root").alias("_further"))
        named = named.join(further, "root", "left").withColumn("root", F.coalesce("_further", "root")).drop("_further")
        free_shuffles(spark)
    classes = write_table(named.join(named.groupBy("root").agg(F.min("id").alias("class_id")), "root").select("key", "class_id"), "classes")
    for table in [*made, unmet]:
        drop_table(table)
    return rows.select("id", "key").join(classes, "key").select(F.col("id").alias(id_col), "key", "class_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, whole and unchanged, one for each class of near_classes: that of the least id.

    Where several rows of the class have that id, the one with the least text hash stays, and of equal rows one.
    Rows of classes whose ids are all null stay, one for each text.
    """
    classes = write_table(near_classes(docs.select(quoted(id_col), quoted(text_col)), id_col, text_col).withColumnRenamed("class_id", "_class"), "classes")
    firsts = classes.where(quoted(id_col).eqNullSafe(F.col("_class"))).withColumn("_no_id", F.when(F.col("_class").isNull(), F.col("key")))
    kept = firsts.groupBy("_class", "_no_id").agg(F.min("key").alias("_keep"), F.count(F.lit(1)).alias("_n")).drop("_no_id")
    key = text_key(F.coalesce(quoted(text_col), F.lit("")))
    away, back = shielded(docs, ("_keep", "_class", "_n"))
    out = away.join(kept, (key == F.col("_keep")) & quoted(id_col).eqNullSafe(F.col("_class")))
    plain = back(out.where("_n = 1"))
    return plain.unionAll(back(out.where("_n > 1").dropDuplicates(["_keep", "_class"]))) if kept.where("_n > 1").head(1) else plain
