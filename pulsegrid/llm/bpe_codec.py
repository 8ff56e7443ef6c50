"""BPE encoding and decoding with a contiguous rank array per word.

A short word is a list of part boundaries beside the ranks of adjacent parts. The smallest rank is found by
scanning, its boundary is deleted, and the ranks of the two neighbours are looked up again. The scan is
quadratic in the word's length, so a word of over LONG_WORD bytes goes to the heap form of the same merges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pulsegrid.llm import vocabulary
from pulsegrid.llm.common import add_columns, texts_of, tune
from pulsegrid.llm.token_counts import merged_ids
from pulsegrid.llm.vocabulary import ID_BITS, Remembered, Vocabulary

LONG_WORD = 256


def encode_word(word: bytes, vocab: Vocabulary) -> list[int]:
    if len(word) > LONG_WORD:
        return merged_ids(word, vocab)
    ranks, merged, none = vocab.ranks, vocab.merged, len(vocab.merged)
    parts = [vocab.byte_ids[b] for b in word]
    adjacent = [ranks.get(a << ID_BITS | b, none) for a, b in zip(parts, parts[1:])]
    while adjacent:
        rank = min(adjacent)
        if rank == none:
            break
        i = adjacent.index(rank)
        parts[i] = merged[rank]
        del parts[i + 1], adjacent[i]
        if i < len(adjacent):
            adjacent[i] = ranks.get(parts[i] << ID_BITS | parts[i + 1], none)
        if i:
            adjacent[i - 1] = ranks.get(parts[i - 1] << ID_BITS | parts[i], none)
    return parts


class Codec(Remembered):
    """Packed ids are little-endian unsigned 32-bit integers."""

    def __init__(self, vocab: Vocabulary):
        super().__init__(vocab, lambda word: np.array(encode_word(word, vocab), "<u4").tobytes(), b"".join)

    def encode_text(self, text: str) -> bytes:
        return self.text(text, lambda i: np.array([i], "<u4").tobytes())

    def decode(self, packed: bytes) -> str:
        """The text of the ids; ids outside the vocabulary give nothing, bytes that are not UTF-8 give U+FFFD."""
        pieces, n = self.vocab.pieces, len(self.vocab.pieces)
        ids = np.frombuffer(packed, "<u4")
        ids = ids[ids < n] if len(ids) and int(ids.max()) >= n else ids
        return b"".join(map(pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")


def bpe_encode(df: DataFrame, tokenizer: str, text_col: str = "text", ids_col: str = "ids", count_col: str = "n_tokens", decoded_col: str | None = None) -> DataFrame:
    """df with the packed ids (binary) and their number (long) of whole texts; a narrow stage, no shuffle.

    With decoded_col, the text read back from those very ids is added in the same pass. Null and empty texts
    give no ids. Columns of the output names are replaced, all others pass through; repeated rows are encoded
    each on its own; an empty table gives an empty table. tokenizer: as in token_counts.
    """
    tune(df.sparkSession)
    data = vocabulary.shared(df.sparkSession, tokenizer)
    fields = [T.StructField(ids_col, T.BinaryType(), False), T.StructField(count_col, T.LongType(), False)]
    fields += [T.StructField(decoded_col, T.StringType(), False)] if decoded_col else []

    def make():
        codec = Codec(vocabulary.load(data))

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            ids = [codec.encode_text(t) for t in texts_of(batch.column(text_col))]
            out = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
            return out + ([pa.array([codec.decode(x) for x in ids], pa.string())] if decoded_col else [])

        return work

    return add_columns(df, [text_col], fields, make)


def bpe_decode(df: DataFrame, tokenizer: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with the text of packed ids; null ids give an empty text. Otherwise as bpe_encode."""
    tune(df.sparkSession)
    data = vocabulary.shared(df.sparkSession, tokenizer)

    def make():
        decode = Codec(vocabulary.load(data)).decode
        return lambda batch: [pa.array([decode(x or b"") for x in batch.column(ids_col).to_pylist()], pa.string())]

    return add_columns(df, [ids_col], [T.StructField(out_col, T.StringType(), False)], make)
