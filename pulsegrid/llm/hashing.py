"""Vectorised 64-bit hashes of words and word runs, over many texts at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: Bytes of text that are hashed at a time: the bound of the arrays in a task, unless one text is longer.
CHUNK = 1 << 21

#: The ASCII white space that parts words, and odd multipliers with well mixed bits.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
GOLDEN, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_is_space = np.zeros(256, bool)
_is_space[list(SPACE)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every bit depends on every other."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


_values = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
BASE = np.uint64(0x2545F4914F6CDD1D | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers.get(name, ())) < n:
        p = np.full(max(n, CHUNK + 4096), base, np.uint64)
        p[0] = 1
        _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers[name][:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """H with H[i] = sum of values[j] * BASE**j over j < i, modulo 2**64."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers("up", BASE, len(values)), out=out[1:])
    return out


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """prefix_sums of a value for each byte."""
    return prefix_sums(_values[data])


#: Bytes of a word that are hashed eight at a time; longer words are few, and each is hashed by itself.
LONG_WORD = 256
KEY = np.uint64(0xA0761D6478BD642F)
_masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]: eight bytes at a time are mixed into what the bytes before them gave.

    Every step is a bijection of the eight bytes that depends on all bits before, so there is no sum or power in which
    regular words could cancel out.
    """
    padded = np.r_[data, np.zeros(8, np.uint8)]
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    lengths = ends - starts
    out = mix(lengths.astype(np.uint64) * GOLDEN ^ KEY)
    at = np.flatnonzero(lengths <= LONG_WORD)
    for k in range(0, LONG_WORD, 8):
        if k:
            at = at[lengths[at] > k]
        if not len(at):
            break
        out[at] = mix((out[at] ^ (eights[starts[at] + k] & _masks[np.minimum(lengths[at] - k, 8)])) * MIX2 + KEY)
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (in b" ".join(texts)) of each word, and the first word of each text and one more."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    gap = _is_space[data]
    before = np.r_[True, gap[:-1]]
    starts, ends = np.flatnonzero(before & ~gap), np.flatnonzero(gap & ~before)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    firsts = np.searchsorted(starts, np.r_[0, np.cumsum(lengths)])
    return word_hashes(data, starts, ends), starts, ends, firsts


def chunked(texts: list[bytes], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts that add up to about size bytes at most, or one longer text."""
    lo = total = 0
    for i, t in enumerate(texts):
        if i > lo and total + len(t) > size:
            yield lo, i
            lo, total = i, 0
        total += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of each distinct run of width words, sorted by both; a shorter text with words is one run."""
    hashes, _, _, firsts = words_of(texts)
    n = np.diff(firsts)
    runs = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(texts)), runs)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs) + firsts[:-1][doc]
    total, end = np.zeros(len(doc), np.uint64), firsts[1:][doc]
    for k in range(width):
        place = at + k
        value = hashes[np.minimum(place, max(len(hashes) - 1, 0))] if len(hashes) else np.zeros(0, np.uint64)
        total = mix(total * GOLDEN + np.where(place < end, value, np.uint64(k + 1)))
    order = np.argsort(total, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    doc, total = doc[order], total[order]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (total[1:] != total[:-1])]) if len(doc) else np.zeros(0, np.int64)
    return doc[new], total[new], np.diff(np.r_[new, len(doc)])
