"""Substring dedup by recompression.

A text is a row of words, named by their hashes. Rounds alternate: maximal runs of one symbol become a symbol, then
adjacent symbols of which the first is on the left side and the second on the right side become one; a symbol's
side is a bit of its name. Names are hashes of what they stand for, so that every block of the corpus gives equal
material the same name. Whether a symbol arises depends on the symbols beside it, so each carries the span of words
that decide it; inside a repeat all symbols with their span within it arise alike. The highest such symbol of each
window is its anchor: anchors that are shared reveal repeats, which are then verified word by word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pulsegrid.llm.common import add_columns, shielded
from pulsegrid.llm.hashing import BASE, GOLDEN, INVERSE, mix, powers, words_of
from pulsegrid.llm.repeats import Anchors, Contexts, Kind, cut_repeats, flat, removed_runs

WINDOW, LEVELS = 20, 2
FAR = 1 << 40
SPACES = bytes.maketrans(b"\x09\x0a\x0b\x0c\x0d", b"     ")


def split_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Hashes of the words, the first word of each text and one more, and the texts with each word's start and end."""
    hashes, starts, ends, firsts = words_of(texts)
    return hashes, firsts, (texts, starts, ends)


def exact_words(texts: list[bytes]) -> np.ndarray:
    """A number for each word, the same for words of the same bytes and for no others, within these texts."""
    known: dict[bytes, int] = {}
    words = [known.setdefault(w, len(known)) for t in texts for w in t.translate(SPACES).split(b" ") if w]
    return np.array(words, np.int64)


def send_words(c: Contexts, source: tuple) -> np.ndarray:
    """The text from the first to the last word of each context, with one space after: closer packed than hashes."""
    texts, starts, ends = source
    data, low, end = np.frombuffer(b" ".join(texts) + b" ", np.uint8), starts[c.start], ends[c.start + c.windows + WINDOW - 2] + 1
    return data[flat(low, end - low)]


def receive_words(sent: list[np.ndarray]) -> tuple[np.ndarray, tuple]:
    texts = [x.tobytes() for x in sent]
    return exact_words(texts), split_words(texts)[2]


def joined(name: np.ndarray, doc: np.ndarray, low: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray, new: np.ndarray):
    """One step: symbols first..last become those named new; each is decided by the symbols from one before to one after."""
    before, after = np.maximum(first - 1, 0), np.minimum(last + 1, len(doc) - 1)
    low = np.where((first > 0) & (doc[before] == doc[first]), low[before], -FAR)
    end = np.where((last + 1 < len(doc)) & (doc[after] == doc[last]), end[after], FAR)
    return new, doc[first], low, end


def levels(units: np.ndarray, firsts: np.ndarray, rounds: int = LEVELS):
    """For each level from 0: names of the symbols, first word of each, and the span of words that decides it."""
    name, at = units, np.arange(len(units))
    doc = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    low, end = at, at + 1
    yield name, at, low, end
    for _ in range(rounds):
        if not len(name):
            return
        head = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])])
        tail = np.r_[head[1:], len(name)] - 1
        size = (tail - head + 1).astype(np.uint64)
        runs = np.where(size > 1, mix(name[head] * GOLDEN + size), name[head])
        at = at[head]
        name, doc, low, end = joined(name, doc, low, end, head, tail, runs)
        right = (mix(name) & np.uint64(1)).astype(bool)
        pair = np.r_[~right[:-1] & right[1:] & (doc[1:] == doc[:-1]), False]
        head = np.flatnonzero(~np.r_[False, pair[:-1]])
        two = pair[head]
        after = np.minimum(head + 1, len(name) - 1)
        pairs = np.where(two, mix(mix(name[head] + GOLDEN) + name[after]), name[head])
        at = at[head]
        name, doc, low, end = joined(name, doc, low, end, head, head + two, pairs)
        yield name, at, low, end


def least_over(start: np.ndarray, end: np.ndarray, key: np.ndarray, n: int, top: np.uint64) -> np.ndarray:
    """The least key of the ranges start to end over each of n places, top where there is none.

    A range is two that overlap, of a power of two places; the tables of each power are handed down from the longest.
    """
    power = np.log2(np.maximum(end - start, 1)).astype(np.int64)
    out = np.full(n, top)
    for k in range(int(power.max(initial=0)), -1, -1):
        mine = power == k
        np.minimum.at(out, start[mine], key[mine])
        np.minimum.at(out, end[mine] - (1 << k), key[mine])
        if k:
            half = 1 << k - 1
            out[half:] = np.minimum(out[half:], out[:-half])
    return out


def window_anchors(units: np.ndarray, firsts: np.ndarray, window: int = WINDOW, rounds: int = LEVELS) -> Anchors:
    """The highest symbol decided within each window; of several the one of least hash, then the leftmost."""
    n = len(units)
    none = np.zeros(0, np.int64)
    inside = np.zeros(n + 1, np.int32)
    long = np.flatnonzero(np.diff(firsts) >= window)
    inside[firsts[long]] += 1
    np.add.at(inside, firsts[long + 1] - window + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside)[:n] > 0)
    if not len(starts):
        return Anchors(none.astype(np.uint64), none, none, none)
    bits = np.uint64(n.bit_length())
    top, places = np.uint64(2**64 - 1), np.uint64((1 << int(bits)) - 1)
    sums = np.r_[np.uint64(0), np.cumsum(mix(units) * powers("up", BASE, n), dtype=np.uint64)]
    best, name_at, level_of = np.full(n, top), np.zeros(n, np.uint64), np.full(n, -1, np.int8)
    for level, (name, at, low, end) in reversed(list(enumerate(levels(units, firsts, rounds)))):
        open_ = level_of < 0
        key = (mix(name ^ np.uint64(level)) >> bits << bits) | at.astype(np.uint64)
        fits = np.flatnonzero(end - low <= window) if open_[starts].any() else starts[:0]
        least = least_over(np.maximum(end[fits] - window, 0), low[fits] + 1, key[fits], n, top)
        found = open_ & (least != top)
        best[found] = least[found]
        level_of[found] = level
        # an anchor's name tells the words that decided its symbol, which are in all its windows
        low, end = np.clip(low, 0, n), np.clip(end, 0, n)
        names = np.zeros(n, np.uint64)
        names[at] = mix(mix(name + np.uint64((level + 1) * int(GOLDEN) & 2**64 - 1)) + (sums[end] - sums[low]) * powers("down", INVERSE, n + 1)[low])
        name_at[found] = names[(best[found] & places).astype(np.int64)]
    at, hashes, level = (best[starts] & places).astype(np.int64), name_at[starts], level_of[starts]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (level[1:] != level[:-1]) | (starts[1:] != starts[:-1] + 1)])
    last = np.r_[new[1:], len(at)] - 1
    return Anchors(hashes[new], at[new], starts[new], starts[last])


def window_classes(c: Contexts, window: int = WINDOW) -> np.ndarray:
    """Classes of equal windows of the contexts: those of one symbol at one distance, verified word by word."""
    at, row = flat(c.start, c.windows), np.repeat(np.arange(len(c.windows)), c.windows)
    distance = (c.offset[row] - (at - c.start[row])).astype(np.uint64)
    symbol = mix(c.hash[row] + distance * GOLDEN)
    out, left, turn = np.empty(len(at), np.int64), np.arange(len(at)), 0
    while len(left):
        key = symbol[left]
        for k in range(window):
            key = mix(key * GOLDEN + c.units[at[left] + k].astype(np.uint64) + np.uint64(turn))
        order = np.argsort(key, kind="stable")
        head = np.r_[True, key[order][1:] != key[order][:-1]]
        number, leader = np.cumsum(head) - 1, left[order[np.flatnonzero(head)]]
        rows, lead = left[order], leader[number]
        same = c.hash[row[rows]] == c.hash[row[lead]]
        for k in range(window):
            same &= c.units[at[rows] + k] == c.units[at[lead] + k]
        out[rows[same]] = lead[same]
        left, turn = np.sort(rows[~same]), turn + 1
    return out


def shared_symbols(exact: np.ndarray, firsts: np.ndarray, a: Anchors) -> Contexts:
    """The windows of a block whose symbols it has more than once."""
    _, which, times = np.unique(a.hash, return_inverse=True, return_counts=True)
    at = np.flatnonzero(times[which] > 1)
    zero = np.zeros(len(at), np.int64)
    return Contexts(a.hash[at], a.at[at] - a.low[at], a.high[at] - a.low[at] + 1, zero, zero, a.low[at], a.low[at], exact)


WORDS = Kind(WINDOW, split_words, window_anchors, lambda units, source: exact_words(source[0]), shared_symbols, send_words, receive_words, window_classes)

ADDED = [
    T.StructField("kept", T.BinaryType(), False), T.StructField("n_words", T.LongType(), False), T.StructField("n_removed", T.LongType(), False), T.StructField("spans", T.ArrayType(T.LongType()), False),
]


def cut_words(texts: list[bytes], firsts: np.ndarray, covered: np.ndarray) -> list[list]:
    kept, removed, spans = [], [], removed_runs(covered, firsts)
    for text, gone in zip(texts, spans):
        words = [w for w in text.translate(SPACES).split(b" ") if w]
        if gone:
            edges = [0, *gone, len(words)]
            words = [w for x, y in zip(edges[::2], edges[1::2]) for w in words[x:y]]
        kept.append(b" ".join(words))
        removed.append(sum(gone[1::2]) - sum(gone[::2]))
    return [kept, np.diff(firsts).tolist(), removed, spans]


def recompression_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with kept (UTF-8 of the words left, joined by one space), n_words, n_removed and spans (first word and
    end of each removed run of words, in turn).

    Words are runs of anything but ASCII white space; a word goes if a run of 20 words over it also starts earlier,
    in a row of smaller id or in the same row. Null texts have no words. Rows of equal id are told apart by their
    place in storage, rows of null id come last; repeated rows thus lose all to the first. Texts of under 20 words
    stay whole. Columns of docs with the names of those added are replaced; an empty table gives an empty table.
    Hashes only bring together what may be equal; words are compared by their bytes.
    """
    return cut_repeats(docs, WORDS, cut_words, ADDED, id_col, text_col)


def dedup_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with repeated runs of words taken out; a text that loses none stays as it is, null too."""
    away, back = shielded(docs, tuple(f.name for f in ADDED))
    found = recompression_dedup(away, id_col, text_col)

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            rows = zip(batch.column(text_col).to_pylist(), batch.column("kept").to_pylist(), batch.column("n_removed").to_pylist())
            return [pa.array([k.decode() if n else t for t, k, n in rows], pa.string())]

        return work

    return back(add_columns(found, [text_col, "kept", "n_removed"], [T.StructField(text_col, T.StringType())], make))
