"""Byte-level BPE vocabularies in the public tokenizer.json format, as plain lookup tables."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import regex

#: The pre-tokenizer pattern that byte-level BPE files of this kind use.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words whose results a task remembers, and the longest of them in characters. Nothing is kept beyond the task:
#: idle Python workers would hold it while other stages need the memory.
MEMORY_WORDS, MEMORY_CHARS = 500_000, 48

#: Bits of a symbol id in a pair key.
ID_BITS = 20


def byte_symbols() -> dict[str, int]:
    """Printable stand-in of each byte: printable bytes stand for themselves, the others follow from 256 on."""
    plain = {b for lo, hi in ((33, 126), (161, 172), (174, 255)) for b in range(lo, hi + 1)}
    rest = iter(range(256, 512))
    return {chr(b) if b in plain else chr(next(rest)): b for b in range(256)}


@dataclass
class Vocabulary:
    """ranks: key of a pair of ids -> rank of its merge; merged: rank -> id of the joined symbol."""

    ranks: dict[int, int]
    merged: list[int]
    byte_ids: list[int]
    pieces: list[bytes]
    special: dict[str, int]
    split_special: regex.Pattern | None
    find: object = field(repr=False, default=None)

    @classmethod
    def parse(cls, data: bytes) -> Vocabulary:
        spec = json.loads(data)
        vocab, back = spec["model"]["vocab"], byte_symbols()
        ranks, merged = {}, []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            ranks[vocab[a] << ID_BITS | vocab[b]] = rank
            merged.append(vocab[a + b])
        pieces = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for text, i in vocab.items():
            pieces[i] = bytes(back[c] for c in text)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in special.items():
            pieces[i] = text.encode()
        inverse = {b: c for c, b in back.items()}
        split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        return cls(ranks, merged, [vocab[inverse[b]] for b in range(256)], pieces, special, split, regex.compile(PATTERN).findall)

    def parts(self, text: str) -> list[str]:
        """A text split at its special strings, which stay as parts of their own."""
        if not self.special or not any(s in text for s in self.special):
            return [text]
        return self.split_special.split(text)


class Remembered:
    """Results of encoding words, for a fixed number of short ones at most: the memory's bound.

    encode: from the UTF-8 bytes of one pre-token to its result; join: from several results to one.
    """

    def __init__(self, vocab: Vocabulary, encode, join):
        self.vocab, self.encode, self.join = vocab, encode, join
        self.words: dict = {}

    def plain(self, text: str) -> list:
        """The results of the words of a text without special strings."""
        words, known = self.vocab.find(text), self.words
        found = list(map(known.get, words))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    word = words[i]
                    found[i] = x = known[word] if word in known else self.encode(word.encode())
                    if len(word) <= MEMORY_CHARS:
                        if len(known) >= MEMORY_WORDS:
                            known.clear()
                        known[word] = x
        return found

    def text(self, text: str, special):
        """special: from the id of a special string to its result."""
        out: list = []
        for part in self.vocab.parts(text):
            i = self.vocab.special.get(part)
            out += self.plain(part) if i is None else [special(i)]
        return self.join(out)


_loaded: dict[int, Vocabulary] = {}


def shared(spark, path: str):
    """A broadcast of the vocabulary file: a fixed file of a few MB, whatever the corpus."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def load(data) -> Vocabulary:
    """The parsed vocabulary of a broadcast, kept for the life of the Python worker."""
    key = hash(data.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary.parse(data.value)
    return _loaded[key]
