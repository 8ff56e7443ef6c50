"""Suffix-array dedup of exact byte substrings.

Each block of whole texts is a shard with a suffix array, made by Larsson-Sadakane refinement: suffixes are sorted by
their first h bytes (six, for most texts), then only unfinished groups by the ranks h, 2h, 4h and so on bytes on.
Kasai's common prefixes, carried along stretches of the shard side by side, give the classes of equal windows, so that
each shard keeps the first of each. Shards are compared where they share anchors, the least hashes among the 32-byte
strings of each 100-byte window: the first windows around shared anchors meet in shards of their own, which are treated
alike; where one anchor fills several of these, their sorted windows are merged by binary search.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pulsegrid.llm.common import add_columns, shielded
from pulsegrid.llm.hashing import INVERSE, mix, powers, prefix_hashes
from pulsegrid.llm.repeats import Anchors, Contexts, Kind, cut_repeats, flat, removed_runs, runs_of, runs_within

WINDOW, GRAM = 100, 32
#: Bytes of a shard, unless one text is longer, and of a stretch of it whose prefixes are followed side by side.
SHARD, STRETCH = 1 << 21, 256
#: Windows whose anchors are sought at a time.
PIECE = 1 << 16


def split_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, None]:
    return np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))], None


def send_bytes(c: Contexts, _: None) -> np.ndarray:
    return c.units[flat(c.start, c.windows + WINDOW - 1)]


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each width values in a row."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def window_anchors(units: np.ndarray, firsts: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> Anchors:
    """The leftmost least-hashed gram of every window within one text."""
    n = len(units)
    none = np.zeros(0, np.int64)
    if n < window:
        return Anchors(none.astype(np.uint64), none, none, none)
    grams, chosen, more = np.empty(n - gram + 1, np.uint64), np.empty(n - window + 1, np.int32 if n < 1 << 31 else np.int64), window - gram
    # piece by piece, so that what is computed on the way stays small; the place within a piece parts equal hashes
    bits = np.uint64((PIECE + more).bit_length())
    for lo in range(0, len(chosen), PIECE):
        part = units[lo : lo + PIECE + window - 1]
        h = prefix_hashes(part)
        g = mix((h[gram:] - h[:-gram]) * powers("down", INVERSE, len(part) - gram + 1))
        grams[lo : lo + len(g)] = g
        least = sliding_least((g >> bits << bits) | np.arange(len(g), dtype=np.uint64), more + 1)
        chosen[lo : lo + len(least)] = (least & np.uint64((1 << int(bits)) - 1)).astype(chosen.dtype) + lo
    inside = np.zeros(n + 1, np.int32)
    long = np.flatnonzero(np.diff(firsts) >= window)
    inside[firsts[long]] += 1
    np.add.at(inside, firsts[long + 1] - window + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside)[: len(chosen)] > 0)
    if not len(starts):
        return Anchors(none.astype(np.uint64), none, none, none)
    at = chosen[starts].astype(np.int64)
    del chosen, inside
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])
    last = np.r_[new[1:], len(at)] - 1
    return Anchors(grams[at[new]], at[new], starts[new], starts[last])


def suffix_array(data: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """Places sorted by their next depth bytes or more, equal ones by place; end: for each place, where its text or context ends."""
    order, rank = refined(data, end, depth)[:2]
    return order[np.lexsort((order, rank[order]))]


def placed(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys, equal ones by place, and which of them differ from the one before; keys leave the upper bits
    free, and are changed: sorting values is several times as fast as sorting places by them."""
    key <<= np.uint64(bits)
    key |= np.arange(len(key), dtype=np.uint64)
    key.sort()
    order = (key & np.uint64((1 << bits) - 1)).view(np.int64)
    key >>= np.uint64(bits)
    return order, np.r_[True, key[1:] != key[:-1]][: len(key)]


def refined(data: np.ndarray, end: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array to depth bytes, equal ones in any order; the rank of each place; the slots that shared bytes with
    others before the last round; and for each of these how many bytes it shares at least with the one before it."""
    n = len(data)
    # places and ranks as small as they can be: they are looked up at random
    small = np.int32 if n < 1 << 31 else np.int64
    symbols = np.flatnonzero(np.bincount(data, minlength=1))
    code = np.zeros(256, np.uint16)
    code[symbols] = np.arange(1, len(symbols) + 1)
    bits, width = n.bit_length(), max(1, len(symbols).bit_length())
    # as many symbols as fit above the place; 0 is the end, so that an end comes before every symbol
    h = min(8, (64 - bits) // width)
    padded, key = np.r_[code[data], np.zeros(h, np.uint16)], np.zeros(n, np.uint64)
    for k in range(h):
        key <<= np.uint64(width)
        key |= padded[k : k + n]
    room = end - np.arange(n)
    short = np.flatnonzero(room < h)
    cut = (width * (h - room[short])).astype(np.uint64)
    key[short] = key[short] >> cut << cut
    del padded, room
    order, head = placed(key, bits)
    order = order.astype(small)
    del key
    rank, leads = np.empty(n, small), np.flatnonzero(head).astype(small)
    rank[order] = np.repeat(leads, np.diff(np.r_[leads, n])) if n else 0
    open_slots = np.flatnonzero(~(head & np.r_[head[1:], True][:n]))
    deep, shared = open_slots, np.where(head[open_slots], 0, h)
    while h < depth and len(open_slots):
        places = order[open_slots]
        lead = rank[places] == open_slots
        deep, shared = open_slots, np.where(lead, 0, h)
        onward = np.where(places + h < end[places], rank[np.minimum(places + h, n - 1)] + 1, 0)
        group, bits = np.cumsum(lead, dtype=np.uint64), len(places).bit_length()
        if int(group[-1]).bit_length() + n.bit_length() + bits <= 64:
            group <<= np.uint64(n.bit_length())
            group |= onward.astype(np.uint64)
            sorting, head = placed(group, bits)
        else:
            sorting = np.lexsort((onward, group))
            group, onward = group[sorting], onward[sorting]
            head = np.r_[True, (group[1:] != group[:-1]) | (onward[1:] != onward[:-1])]
        places = places[sorting]
        order[open_slots] = places
        del group, onward, sorting, lead
        leads = np.flatnonzero(head)
        rank[places] = np.repeat(open_slots[leads].astype(small), np.diff(np.r_[leads, len(head)]))
        shared = np.where(head, shared, 2 * h)
        open_slots = open_slots[~(head & np.r_[head[1:], True])]
        h *= 2
    return order, rank, deep, shared


def common_prefixes(data: np.ndarray, order: np.ndarray, starts: np.ndarray, ends: np.ndarray, end: np.ndarray, most: int, least: np.ndarray | None = None) -> np.ndarray:
    """For each place the bytes, most at most, that it shares with the one before it in order.

    Kasai's way: a place shares at least one byte less than the place to its left did. All stretches starts to ends go
    from left to right at the same time; places in none of them count what is
    known of them, else 0. least: bytes that each place is known to share; those
    that share most of them or more need not be in order among each other, so they are in no stretch.
    """
    before = np.empty(len(order), order.dtype if order.dtype.kind == "i" else np.int64)
    before[order[1:]], before[order[:1]] = order[:-1], -1
    shared = np.zeros(len(order), np.int32) if least is None else np.minimum(least, most)
    carried = np.zeros(len(starts), np.int64)
    lengths = ends - starts
    by_length = np.argsort(-lengths, kind="stable")
    for t in range(int(lengths.max(initial=0))):
        live = by_length[: np.searchsorted(-lengths[by_length], -t, "left")]
        i = starts[live] + t
        j = before[i].astype(np.int64)
        room = np.where(j >= 0, np.minimum(np.minimum(end[i] - i, end[np.maximum(j, 0)] - j), most), 0)
        h = np.minimum(np.maximum(carried[live] - 1, 0 if least is None else least[i]), room)
        grow = np.flatnonzero(h < room)
        while len(grow):
            grow = grow[data[i[grow] + h[grow]] == data[j[grow] + h[grow]]]
            h[grow] += 1
            grow = grow[h[grow] < room[grow]]
        shared[i], carried[live] = h, h
    return shared


def shard_classes(c: Contexts, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows of a shard, row by row: the class of equal ones, by its least window in suffix order; and all
    windows in suffix order.

    Suffixes run on to the end of the shard, over the ends of rows: a window lies within its row, so that two of them
    share window bytes or more just where they are equal. Prefixes are followed where the last refinement still had
    company: elsewhere fewer bytes than a window are shared.
    """
    lengths = c.windows + window - 1
    data, ends = c.units[flat(c.start, lengths)], np.cumsum(lengths)
    starts, end, first = ends - lengths, np.broadcast_to(np.int64(len(data)), len(data)), np.cumsum(c.windows) - c.windows

    def windows_at(places: np.ndarray) -> np.ndarray:
        """The numbers of the windows that start at places, -1 where none does."""
        row = np.searchsorted(ends, places, "right")
        step = places - starts[row]
        return np.where(step < c.windows[row], first[row] + step, -1)

    order, _, deep, known = refined(data, end, window)
    at = order[deep]
    least = np.zeros(len(data), np.int32)
    least[at] = known
    places = np.sort(at[known < window])
    head, last = runs_within(places // STRETCH, places)
    shared = common_prefixes(data, order, places[head], places[last] + 1, end, window, least)
    number = windows_at(at)
    # suffixes of one run share a window each with the one before, be that a window or not
    run = np.cumsum(shared[at] < window)[number >= 0]
    mine = number[number >= 0]
    head, last = runs_of(run)
    classes = np.arange(int(c.windows.sum()))
    classes[mine] = np.repeat(mine[head], last - head)
    return classes, order


def windows_in_order(c: Contexts, window: int, classes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """One window of each class, in suffix order."""
    lengths = c.windows + window - 1
    number = np.full(len(order), -1, np.int64)
    number[flat(np.cumsum(lengths) - lengths, c.windows)] = np.arange(len(classes))
    number = number[order]
    number = number[number >= 0]
    return number[classes[number] == number]


def whole_texts(units: np.ndarray, firsts: np.ndarray, _: Anchors) -> Contexts:
    """Every text of a block as one row: the block's suffix array is that of its whole texts."""
    at = np.flatnonzero(np.diff(firsts) >= WINDOW)
    zero, low = np.zeros(len(at), np.int64), firsts[at]
    return Contexts(zero.astype(np.uint64), zero, firsts[at + 1] - low - WINDOW + 1, zero, zero, low, low, units)


def shards_of(hashes: np.ndarray, lengths: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows of each shard; rows of one hash are parted only where they alone are more than a shard."""
    order = np.argsort(hashes, kind="stable")
    out, held, total = [], [], 0
    for lo, hi in zip(*runs_of(hashes[order])):
        rows = order[lo:hi]
        mine = int(lengths[rows].sum())
        if held and total + mine > size:
            out.append(np.concatenate(held))
            held, total = [], 0
        if mine > size:
            out += np.split(rows, np.flatnonzero(np.diff(np.cumsum(lengths[rows]) // size)) + 1)
        else:
            held.append(rows)
            total += mine
    return out + ([np.concatenate(held)] if held else [])


def window_classes(c: Contexts, window: int = WINDOW, size: int = SHARD) -> np.ndarray:
    """Classes of equal windows over all rows of c, each the number of one of its windows, from the shards' suffix arrays."""
    shards = shards_of(c.hash, c.windows + window - 1, size)
    if len(shards) == 1:
        return shard_classes(c, window)[0]
    first = np.cumsum(c.windows) - c.windows
    out, known = np.empty(int(c.windows.sum()), np.int64), {}
    parted = {int(h) for a, b in zip(shards, shards[1:]) for h in np.intersect1d(c.hash[a], c.hash[b])}
    place = flat(c.start, c.windows)
    for rows in shards:
        part = c.take(rows)
        at = flat(first[rows], part.windows)
        classes, order = shard_classes(part, window)
        if len(h := np.unique(part.hash)) == 1 and int(h[0]) in parted:
            # every such shard has one hash: its sorted windows are looked up among those of the shards before it
            heads = windows_in_order(part, window, classes, order)
            content = c.units[place[at[heads]][:, None] + np.arange(window)].view(f"S{window}").reshape(-1)
            mine = at[heads]
            for other, theirs in known.get(int(h[0]), []):
                k = np.minimum(np.searchsorted(other, content), len(other) - 1)
                mine = np.where(other[k] == content, theirs[k], mine)
            rename = np.empty(len(classes), np.int64)
            rename[heads] = mine
            out[at] = rename[classes]
            known.setdefault(int(h[0]), []).append((content, mine))
        else:
            out[at] = at[classes]
    return out


BYTES = Kind(WINDOW, split_bytes, window_anchors, lambda units, _: units, whole_texts, send_bytes, lambda sent: (np.concatenate(sent), None), window_classes)

ADDED = [
    T.StructField("kept", T.BinaryType(), False), T.StructField("n_bytes", T.LongType(), False), T.StructField("n_removed", T.LongType(), False), T.StructField("spans", T.ArrayType(T.LongType()), False),
]


def cut_bytes(texts: list[bytes], firsts: np.ndarray, covered: np.ndarray) -> list[list]:
    kept, removed, spans = [], [], removed_runs(covered, firsts)
    for text, gone in zip(texts, spans):
        edges = [0, *gone, len(text)]
        kept.append(b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2])) if gone else text)
        removed.append(sum(gone[1::2]) - sum(gone[::2]))
    return [kept, list(map(len, texts)), removed, spans]


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with kept (bytes left), n_bytes, n_removed and spans (start and end of each removed run, in turn).

    Texts are UTF-8 bytes, null as empty; a byte goes if a 100-byte string over it also starts earlier, in a row
    of smaller id or in the same row. Rows of equal id are told apart by their place in storage, rows of null id
    come last; repeated rows thus lose all to the first. Texts of under 100 bytes stay whole. Columns of docs
    with the names of those added are replaced; an empty table gives an empty table.
    """
    return cut_repeats(docs, BYTES, cut_bytes, ADDED, id_col, text_col)


def whole_characters(text: bytes, spans: list[int]) -> str:
    """The text without the spans, each drawn in to the whole characters within it."""
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]]).decode("utf-8", "replace")


def dedup_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with repeated substrings taken out of the texts; null texts stay null."""
    away, back = shielded(docs, tuple(f.name for f in ADDED))
    found = suffix_dedup(away, id_col, text_col).drop("kept")

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            texts, spans = batch.column(text_col).to_pylist(), batch.column("spans").to_pylist()
            return [pa.array([t if t is None or not s else whole_characters(t.encode(), s) for t, s in zip(texts, spans)], pa.string())]

        return work

    return back(add_columns(found, [text_col, "spans"], [T.StructField(text_col, T.StringType())], make))
