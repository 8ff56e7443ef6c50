"""Finding repeated windows of units (bytes or words) over a corpus, and cutting all occurrences but the first.

The work both substring operators share. Texts are packed into blocks, in order of their ids, and written once. Inside
a block, equal windows are found over the whole texts. Across blocks, every window has one anchor that its own units
decide, so that equal windows have equal anchors at equal distances. Hashes of anchors meet by value; each block
learns which of its anchors other blocks have too, and sends those anchors' contexts (the units of all their windows
that are the first of their kind in the block) to be compared exactly with the contexts of the same anchor from other
blocks. What is found comes back to the blocks, which cut it out.

An anchor that occurs very often, with ever different surroundings, would fill one group: its contexts are parted into
single windows, which go to groups by their own content.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import Fields, batch_of, ddl, drop_table, free_shuffles, give_back, giving_back, quoted, tune, write_table
from pulsegrid.llm.hashing import CHUNK, INVERSE, mix, powers, prefix_hashes, prefix_sums

#: Bytes of text in a block, unless one text is longer; blocks whose anchors, or contexts, meet in one group.
BLOCK_BYTES, ANCHOR_BLOCKS, CONTEXT_BLOCKS = 1 << 20, 8, 4
LEAST_GROUPS = 32
#: Blocks whose equal contexts of one anchor meet at a time: with more blocks, contexts are thinned in rounds first.
MEET_BLOCKS = 2048
NO_ID = 2**63 - 1
#: Occurrences from which an anchor's contexts are parted, and the bits of a hash that carry a count's logarithm.
HOT, COUNT_BITS = 1 << 14, np.uint64(15)

L, B = pa.int64(), pa.binary()
BLOCKS: Fields = {"block": L, "data": B}
ANCHORS: Fields = {"bucket": L, "block": L, "hashes": B}
REPEATED: Fields = {"block": L, "hashes": B}
CONTEXTS: Fields = {"bucket": L, "block": L, "data": B}


@dataclass
class Anchors:
    """hash, and the starts of the first and last window that belong to each anchor, in units of the block; at: a place tied to the anchor."""

    hash: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray


@dataclass
class Contexts:
    """Rows in order of document, block and place; units of row i are units[start[i] : start[i] + windows[i] + window - 1]."""

    hash: np.ndarray
    offset: np.ndarray
    windows: np.ndarray
    id: np.ndarray
    block: np.ndarray
    low: np.ndarray
    start: np.ndarray
    units: np.ndarray

    def take(self, rows: np.ndarray) -> Contexts:
        return Contexts(*(getattr(self, f)[rows] for f in ("hash", "offset", "windows", "id", "block", "low", "start")), self.units)


@dataclass
class Kind:
    """What makes the two operators differ.

    split: texts -> (units, first unit of each text and one more, what send needs of the texts); anchors: (units,
    firsts) -> Anchors; inside: (exact units, firsts, Anchors) -> Contexts, in order, with all windows of a block that may be equal; exact: (units, what send needs) -> units that are equal only if what they stand for is; send: (Contexts, what send needs) -> their units as bytes; receive: several such bytes -> (units,
    what send needs to send them on); classes: Contexts -> class of each window, row by row, as the number of one of its windows.
    """

    window: int
    split: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, object]]
    anchors: Callable[[np.ndarray, np.ndarray], Anchors]
    exact: Callable[[np.ndarray, object], np.ndarray]
    inside: Callable[[np.ndarray, np.ndarray, Anchors], Contexts]
    send: Callable[[Contexts, object], np.ndarray]
    receive: Callable[[list[np.ndarray]], tuple[np.ndarray, object]]
    classes: Callable[[Contexts], np.ndarray]


def flat(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each row, one row after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths - starts, lengths)


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.r_[0, cut][: len(values)], np.r_[cut, len(values)][: len(cut) + bool(len(values))]


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([a.nbytes for a in arrays], "<i8").tobytes()
    return zstandard.compress(head + b"".join(a.tobytes() for a in arrays), 1)


def unpack(data: bytes, *dtypes: str) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    sizes, at, out = np.frombuffer(raw, "<i8", len(dtypes)), 8 * len(dtypes), []
    for size, dtype in zip(sizes.tolist(), dtypes):
        out.append(np.frombuffer(raw, dtype, size // np.dtype(dtype).itemsize, at))
        at += size
    return out


def pack_block(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def block_table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def texts_in(table: pa.Table, text_col: str) -> list[bytes]:
    return [x or b"" for x in table.column(text_col).cast(pa.binary()).to_pylist()]


def pack_blocks(batches: Iterator[pa.RecordBatch], id_col: str, text_col: str) -> Iterator[pa.RecordBatch]:
    number, held, size = TaskContext.get().partitionId() << 32, [], 0

    def out() -> pa.RecordBatch:
        nonlocal number, held, size
        number += 1
        table = pa.Table.from_batches(held)
        row, held, size = [number, pack_block(table.take(pa.array(np.argsort(ids_of(table, id_col), kind="stable"))))], [], 0
        return batch_of([row], BLOCKS)

    for batch in batches:
        lengths = np.array([len(x or b"") for x in batch.column(text_col).cast(pa.binary()).to_pylist()])
        lo = 0
        for i, n in enumerate(lengths.tolist()):
            if size + n > BLOCK_BYTES and size:
                if i > lo:
                    held.append(batch.slice(lo, i - lo))
                lo = i
                yield out()
            size += n + 1
        if lo < batch.num_rows:
            held.append(batch.slice(lo))
    if held:
        yield out()


def same_units(units: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the units from a and from b agree over the whole length, row by row."""
    if not len(a):
        return np.zeros(0, bool)
    if units.itemsize == 1 and lengths.min() >= 8:  # bytes, eight at a time, the last eight again if need be
        units, steps = np.ndarray(len(units) - 7, "<u8", np.ascontiguousarray(units), strides=(1,)), -(-lengths // 8)
        skip = np.minimum(8 * flat(np.zeros(len(steps), np.int64), steps), np.repeat(lengths - 8, steps))
        equal = units[np.repeat(a, steps) + skip] == units[np.repeat(b, steps) + skip]
    else:
        steps, equal = lengths, units[flat(a, lengths)] == units[flat(b, lengths)]
    return np.logical_and.reduceat(equal, np.cumsum(steps) - steps)


def content_hash(units: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each row's units, from prefix sums over CHUNK of them at a time."""
    out, order = np.zeros(len(starts), np.uint64), np.argsort(starts, kind="stable")
    cuts = np.searchsorted(starts[order], np.arange(0, len(units) + 1, CHUNK))
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
        rows = order[lo:hi]
        if not len(rows):
            continue
        at, size = starts[rows] - starts[rows[0]], lengths[rows]
        part = units[starts[rows[0]] :][: int((at + size).max())]
        h = prefix_hashes(part) if part.itemsize == 1 else prefix_sums(mix(part.astype(np.uint64)))
        out[rows] = mix((h[at + size] - h[at]) * powers("down", INVERSE, len(part) + 1)[at] + size.astype(np.uint64))
    return out


def merged(c: Contexts, window: int) -> np.ndarray:
    """For each context the first one that is the same as a whole, in anchor, distance and units; contexts are in order.

    Contexts of different blocks are looked up in sorted order by a hash of their units, and then compared.
    """
    lengths = c.windows + window - 1
    key = mix(content_hash(c.units, c.start, lengths) ^ c.hash) + c.offset.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order][1:] != key[order][:-1]][: len(order)]
    first = np.empty(len(order), np.int64)
    first[order] = order[new][np.cumsum(new) - 1] if len(order) else order
    late = np.flatnonzero(first != np.arange(len(first)))
    lead = first[late]
    equal = (c.hash[late] == c.hash[lead]) & (c.offset[late] == c.offset[lead]) & (c.windows[late] == c.windows[lead])
    equal[equal] = same_units(c.units, c.start[late[equal]], c.start[lead[equal]], lengths[late[equal]])
    first[late[~equal]] = late[~equal]
    return first


def late_windows(classes: np.ndarray) -> np.ndarray:
    """Of windows in order, those of a class that an earlier one has; a class is the number of one of its windows."""
    late, others = np.zeros(len(classes), bool), np.flatnonzero(classes != np.arange(len(classes)))
    members = np.unique(np.r_[others, classes[others]])
    order = members[np.argsort(classes[members], kind="stable")]
    late[order[1:]] = classes[order[1:]] == classes[order[:-1]]
    return late


def by_block(block: np.ndarray, low: np.ndarray, end: np.ndarray) -> Iterator[list]:
    order = np.argsort(block, kind="stable")
    for lo, hi in zip(*runs_of(block[order])):
        part = order[lo:hi]
        yield [-1, int(block[part[0]]), pack(low[part].astype("<i8"), end[part].astype("<i8"))]


def runs_within(row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs in which the row stays and the start goes up by one."""
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)])
    return cut, np.r_[cut[1:], len(row)] - 1


def joined(parts: list[Contexts]) -> Contexts:
    """Contexts over the same units, one after the other."""
    return Contexts(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("hash", "offset", "windows", "id", "block", "low", "start")), parts[0].units)


def first_windows(c: Contexts, kind: Kind) -> tuple[list[list], Contexts]:
    """Marks of the windows of c (rows in order) that also start earlier in c; and the contexts of all others.

    Of contexts that are the same as a whole the first stays; those left whose anchor has several are told apart window
    by window.
    """
    first = merged(c, kind.window)
    own = first == np.arange(len(first))
    again = np.flatnonzero(~own)
    marks = list(by_block(c.block[again], c.low[again], c.low[again] + c.windows[again]))
    c = c.take(np.flatnonzero(own))
    _, which, times = np.unique(c.hash, return_inverse=True, return_counts=True)
    alone, c = c.take(np.flatnonzero(times[which] == 1)), c.take(np.flatnonzero(times[which] > 1))
    late = late_windows(kind.classes(c))
    row, step = np.repeat(np.arange(len(c.windows)), c.windows), flat(np.zeros(len(c.windows), np.int64), c.windows)
    at = np.flatnonzero(late)
    head, last = runs_within(row[at], step[at])
    head, last = at[head], at[last]
    marks += by_block(c.block[row[head]], c.low[row[head]] + step[head], c.low[row[last]] + step[last] + 1)
    at = np.flatnonzero(~late)
    head, last = runs_within(row[at], step[at])
    return marks, joined([alone, parts_of(c, row[at[head]], step[at[head]], step[at[last]] - step[at[head]] + 1)])


def parts_of(c: Contexts, row: np.ndarray, skip: np.ndarray, windows: np.ndarray) -> Contexts:
    """Of the rows named, windows from the skip-th on."""
    d = c.take(row)
    return Contexts(d.hash, d.offset - skip, windows, d.id, d.block, d.low + skip, d.start + skip, c.units)


CONTEXT_TYPES = ("<u8", "<i8", "u1", "u1", "<u4")


def pack_contexts(c: Contexts, kind: Kind, source: object) -> bytes:
    return pack(*(x.astype(t) for x, t in zip((c.hash, c.id, c.offset, c.windows, c.low), CONTEXT_TYPES)), kind.send(c, source))


def read_contexts(table: pa.Table, kind: Kind) -> tuple[Contexts, object]:
    """The contexts of several blocks in order, and what is needed to send them on."""
    parts = [unpack(data, *CONTEXT_TYPES, "u1") for data in table.column("data").to_pylist()]
    h, ids, offset, windows, low = (np.concatenate([p[k] for p in parts]) for k in range(5))
    units, source = kind.receive([p[5] for p in parts])
    block, windows = np.repeat(table.column("block").to_numpy(), [len(p[0]) for p in parts]), windows.astype(np.int64)
    lengths = windows + kind.window - 1
    c = Contexts(h, offset.astype(np.int64), windows, ids, block, low.astype(np.int64), np.cumsum(lengths) - lengths, units)
    return c.take(np.lexsort((low, block, ids))), source


def thinned(table: pa.Table, kind: Kind) -> Iterator[list]:
    """The contexts of windows that are the first of their kind, by block as before, and the others as found windows."""
    bucket = table.column("bucket")[0].as_py()
    c, source = read_contexts(table, kind)
    marks, c = first_windows(c, kind)
    for number, block, data in marks:
        yield [number - bucket, block, data]
    order = np.argsort(c.block, kind="stable")
    for lo, hi in zip(*runs_of(c.block[order])):
        yield [bucket, int(c.block[order[lo]]), pack_contexts(c.take(order[lo:hi]), kind, source)]


def ids_of(table: pa.Table, id_col: str) -> np.ndarray:
    return table.column(id_col).cast(pa.int64()).fill_null(NO_ID).to_numpy()


def cut_repeats(docs: DataFrame, kind: Kind, finish: Callable, added: list[T.StructField], id_col: str, text_col: str) -> DataFrame:
    """docs with the columns added by finish(texts, found), found being for each text the runs of removed units.

    A window is removed where its units also start earlier: in a smaller id, or in the same document before it.
    Among rows of equal id, and those of null id, which come last, the place in storage decides.
    """
    spark = docs.sparkSession
    tune(spark)
    names = [f.name for f in added]
    kept = [f for f in docs.schema.fields if f.name not in names]
    blocks = write_table(docs.select(*[quoted(f.name) for f in kept]).mapInArrow(lambda it: giving_back(pack_blocks(it, id_col, text_col)), ddl(BLOCKS)), "blocks")
    count = blocks.count()
    buckets, groups = max(LEAST_GROUPS, count // ANCHOR_BLOCKS), max(LEAST_GROUPS, count // CONTEXT_BLOCKS)
    # as many partitions as the blocks ask for, so that what a task reads does not grow with the corpus
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), count // CONTEXT_BLOCKS)
    one, clear = np.uint64(1), ~COUNT_BITS

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                h = np.sort(kind.anchors(*kind.split(texts_in(block_table(row["data"]), text_col))[:2]).hash & clear)
                lo, hi = runs_of(h)
                h = h[lo] | np.minimum(np.log2(hi - lo).astype(np.uint64), COUNT_BITS)
                bucket = (h >> np.uint64(4)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                yield batch_of([[int(bucket[order[a]]), row["block"], h[order[a:b]].astype("<u8").tobytes()] for a, b in zip(*runs_of(bucket[order]))], ANCHORS)

    def repeated(table: pa.Table) -> pa.Table:
        """For each block the hashes that other blocks have too; the lowest bit tells of very frequent ones."""
        parts = [np.frombuffer(x, "<u8") for x in table.column("hashes").to_pylist()]
        blocks, h = table.column("block").to_numpy(), np.concatenate(parts)
        origin, order = np.repeat(np.arange(len(parts)), list(map(len, parts))), np.argsort(h, kind="stable")
        h, origin = h[order], origin[order]
        lo, hi = runs_of(h & clear)
        times = np.add.reduceat(np.uint64(1) << (h & COUNT_BITS), lo) if len(h) else np.zeros(0, np.uint64)
        again, hot = np.repeat(hi - lo > 1, hi - lo), np.repeat(times >= HOT, hi - lo)
        h, origin = (h & clear | hot.astype(np.uint64))[again], origin[again]
        order = np.argsort(origin, kind="stable")
        rows = [[int(blocks[origin[order[a]]]), h[order[a:b]].astype("<u8").tobytes()] for a, b in zip(*runs_of(origin[order]))]
        return pa.Table.from_batches([batch_of(rows, REPEATED)])

    def sent_from(row: dict, known: np.ndarray) -> Iterator[list]:
        table, block = block_table(row["data"]), row["block"]
        units, firsts, source = kind.split(texts_in(table, text_col))
        a, exact = kind.anchors(units, firsts), kind.exact(units, source)
        within = kind.inside(exact, firsts, a)
        late, starts = late_windows(kind.classes(within)), flat(within.low, within.windows)
        # what the block finds itself goes through the same exchange, in groups of negative numbers
        found = starts[late]
        head, last = runs_within(np.zeros(len(found)), found)
        for _, *rest in by_block(np.full(len(head), block), found[head], found[last] + 1):
            yield [-1 - block % groups, *rest]
        if not len(known):
            return
        gone = np.zeros(len(units) + 1, bool)
        gone[found] = True
        h = a.hash & clear
        near = np.minimum(np.searchsorted(known, h), len(known) - 1)
        at = np.flatnonzero(known[near] & clear == h)
        hot = (known[near[at]] & one).astype(bool)
        ids = ids_of(table, id_col)[np.searchsorted(firsts, a.low[at], "right") - 1]
        c = Contexts(h[at], a.at[at] - a.low[at], a.high[at] - a.low[at] + 1, ids, np.full(len(at), block), a.low[at], a.low[at], exact)
        which, step = np.repeat(np.arange(len(at)), c.windows), flat(np.zeros(len(at), np.int64), c.windows)
        left = np.flatnonzero(~gone[c.low[which] + step])
        head, last = runs_within(np.where(hot[which[left]], np.arange(len(left)) + len(at), which[left]), step[left])
        c, hot = parts_of(c, which[left[head]], step[left[head]], step[left[last]] - step[left[head]] + 1), hot[which[left[head]]]
        if hot.any():
            c.hash[hot] = mix(c.hash[hot] ^ content_hash(units, c.start[hot], np.full(int(hot.sum()), kind.window))) & clear
        bucket = mix(c.hash) % np.uint64(groups)
        order = np.argsort(bucket, kind="stable")
        for lo, hi in zip(*runs_of(bucket[order])):
            yield [int(bucket[order[lo]]), block, pack_contexts(c.take(order[lo:hi]), kind, source)]

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        known = np.sort(np.concatenate([np.zeros(0, "<u8"), *(np.frombuffer(x, "<u8") for x in right.column("hashes").to_pylist())]))
        out = pa.Table.from_batches([batch_of([x for row in left.to_pylist() for x in sent_from(row, known)], CONTEXTS)])
        give_back()
        return out

    def decide(table: pa.Table) -> pa.Table:
        if table.num_rows and table.column("bucket")[0].as_py() < 0:
            return table
        out = pa.Table.from_batches([batch_of(first_windows(read_contexts(table, kind)[0], kind)[0], CONTEXTS)])
        give_back()
        return out

    again = write_table(blocks.mapInArrow(lambda it: giving_back(name(it)), ddl(ANCHORS)).repartition(tasks, "bucket").groupBy("bucket").applyInArrow(repeated, ddl(REPEATED)), "repeated")
    free_shuffles(spark)
    sent = blocks.repartition(tasks, "block").groupBy("block").cogroup(again.repartition(tasks, "block").groupBy("block")).applyInArrow(gather, ddl(CONTEXTS))

    def thin(table: pa.Table) -> pa.Table:
        if table.num_rows and table.column("bucket")[0].as_py() < 0:
            return table
        return pa.Table.from_batches([batch_of(list(thinned(table, kind)), CONTEXTS)])

    parts = -(-count // MEET_BLOCKS)
    while parts > 1:
        # a new deal of the blocks each round: what met in one part comes out of it as one context
        sent = sent.groupBy("bucket", F.pmod(F.xxhash64("block", F.lit(parts)), F.lit(parts))).applyInArrow(thin, ddl(CONTEXTS))
        parts = -(-parts // MEET_BLOCKS)
    found = write_table(sent.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(decide, ddl(CONTEXTS)).select("block", "data"), "marks")
    drop_table(again)
    free_shuffles(spark)
    kept_names, kinds = [f.name for f in kept], {f.name: T_ARROW[f.dataType.simpleString()] for f in added}

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        for row in left.to_pylist():
            table = block_table(row["data"])
            texts = texts_in(table, text_col)
            firsts = kind.split(texts)[1]
            pairs = [unpack(x, "<i8", "<i8") for x in right.column("data").to_pylist()]
            edge = np.zeros(int(firsts[-1]) + 2, np.int32)
            for low, end in pairs:
                np.add.at(edge, low, 1)
                np.add.at(edge, end + kind.window - 1, -1)
            covered = np.cumsum(edge)[:-2] > 0
            columns = finish(texts, firsts, covered)
            tables.append(pa.table({**{c: table.column(c) for c in kept_names}, **{n: pa.array(x, kinds[n]) for n, x in zip(names, columns)}}))
        give_back()
        return pa.concat_tables(tables)

    return blocks.repartition(tasks, "block").groupBy("block").cogroup(found.repartition(tasks, "block").groupBy("block")).applyInArrow(cut, T.StructType(kept + added))


T_ARROW = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}


def removed_runs(covered: np.ndarray, firsts: np.ndarray) -> list[list[int]]:
    """For each text the starts and ends, in turn and within the text, of its runs of removed units."""
    begin, stop = covered.copy(), covered.copy()
    begin[1:] &= ~covered[:-1]
    stop[:-1] &= ~covered[1:]
    full = np.flatnonzero(np.diff(firsts) > 0)
    begin[firsts[full]], stop[firsts[full + 1] - 1] = covered[firsts[full]], covered[firsts[full + 1] - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    cut = np.searchsorted(starts, firsts)
    base = np.repeat(firsts[:-1], np.diff(cut))
    spans = np.stack([starts - base, ends - base], 1).reshape(-1).tolist()
    return [spans[2 * a : 2 * b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
