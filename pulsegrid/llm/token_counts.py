"""Token counts by heap-and-linked-list byte-pair merging, with no identifiers emitted.

Each word starts as its bytes. A heap holds the adjacent pairs by rank and place; the lowest is popped, its
two symbols become one in a doubly linked list, and the pairs to either side are pushed. The count is the
number of initial symbols less the number of merges.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pulsegrid.llm import vocabulary
from pulsegrid.llm.common import add_columns, texts_of, tune
from pulsegrid.llm.vocabulary import ID_BITS, Remembered, Vocabulary


def merge(word: bytes, vocab: Vocabulary, ids: list[int] | None = None) -> int:
    """The number of merges of a word of two bytes or more; ids, if given, are left as the merged symbols, -1 where one is gone.

    adjacent holds the rank of the pair that starts at a place; a popped pair whose rank differs is out of date.
    """
    rank_of, merged, n = vocab.ranks.get, vocab.merged, len(word)
    ids = [vocab.byte_ids[b] for b in word] if ids is None else ids
    shift = n.bit_length()
    adjacent = [rank_of(a << ID_BITS | b, -1) for a, b in zip(ids, ids[1:])]
    adjacent.append(-1)
    heap = [r << shift | i for i, r in enumerate(adjacent) if r >= 0]
    if not heap:
        return 0
    heapify(heap)
    after, before, merges, low = list(range(1, n + 1)), list(range(-1, n - 1)), 0, (1 << shift) - 1
    while heap:
        top = heappop(heap)
        i, rank = top & low, top >> shift
        if adjacent[i] != rank:
            continue
        merges += 1
        j = after[i]
        k = after[j]
        ids[i] = new = merged[rank]
        ids[j] = adjacent[j] = -1
        after[i] = k
        if k < n:
            before[k] = i
            adjacent[i] = r = rank_of(new << ID_BITS | ids[k], -1)
            if r >= 0:
                heappush(heap, r << shift | i)
        else:
            adjacent[i] = -1
        h = before[i]
        if h >= 0:
            adjacent[h] = r = rank_of(ids[h] << ID_BITS | new, -1)
            if r >= 0:
                heappush(heap, r << shift | h)
    return merges


def merged_ids(word: bytes, vocab: Vocabulary) -> list[int]:
    ids = [vocab.byte_ids[b] for b in word]
    merge(word, vocab, ids)
    return [x for x in ids if x >= 0]


def count_word(word: bytes, vocab: Vocabulary) -> int:
    """Initial symbols less merges."""
    return len(word) - merge(word, vocab) if len(word) > 1 else len(word)


class Counter(Remembered):
    """Counts the tokens of texts."""

    def __init__(self, vocab: Vocabulary):
        super().__init__(vocab, lambda word: count_word(word, vocab), sum)

    def count(self, text: str) -> int:
        return self.text(text, lambda _: 1)


def token_counts(df: DataFrame, tokenizer: str, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """df with a long column of token counts of whole texts; a narrow stage, no shuffle.

    Null and empty texts count 0. Repeated rows are counted each on its own. A column named out_col is
    replaced, all others pass through. An empty table gives an empty table. tokenizer: path of a byte-level
    BPE tokenizer.json on the driver; the file (a few MB) is broadcast.
    """
    tune(df.sparkSession)
    data = vocabulary.shared(df.sparkSession, tokenizer)

    def make():
        count = Counter(vocabulary.load(data)).count
        return lambda batch: [pa.array([count(t) for t in texts_of(batch.column(text_col))], pa.int64())]

    return add_columns(df, [text_col], [T.StructField(out_col, T.LongType(), False)], make)
