"""Word and shingle hashes of whole batches of texts, in numpy.

A word is a run of bytes other than ASCII white space (0x20, 0x09 to 0x0D). Its hash is a
polynomial over its bytes modulo 2**64, taken from running sums over the text and then
mixed; equal words have equal hashes. Texts longer than BLOCK bytes are walked in blocks
that end at white space, so memory stays bounded by the block (or one longer word) plus
eight bytes a word.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

BLOCK = 1_000_000
SHINGLE = 5
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_GAP = re.compile(rb"[\x20\x09-\x0d]")
_IS_GAP = np.zeros(256, bool)
_IS_GAP[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n."""
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    up[0] = down[0] = 1
    up[1:], down[1:] = _BASE, np.uint64(pow(int(_BASE), -1, 2**64))
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _block(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of data."""
    b = np.frombuffer(data, np.uint8)
    gap = np.empty(len(b) + 2, bool)
    gap[0] = gap[-1] = True
    gap[1:-1] = _IS_GAP[b]
    turns = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = turns[0::2], turns[1::2]
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    n = max(BLOCK + 1, 1 << int(len(b)).bit_length())
    up, down = _powers(n)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * up[: len(b)], dtype=np.uint64, out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, offsets): text i has words offsets[i] to offsets[i + 1]."""
    data = b"\n".join(texts)
    heads = np.cumsum([0, *(len(t) + 1 for t in texts)])
    if not data:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = len(data)
        if end - at > BLOCK:
            gap = _GAP.search(data, at + BLOCK)
            end = gap.start() if gap else end
        s, h = _block(data[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    starts = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(starts, heads, "left")


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position; fewer than n words give none."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = words[:count].copy()
    for k in range(1, n):
        total = total * _BASE + words[k : k + count]
    return mix(total + np.uint64(n))


def shingle_sets(texts: list[bytes], n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text; a shorter text is one shingle, no words none."""
    words, at = word_hashes(texts)
    grams = ngram_hashes(words, n)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(ngram_hashes(words[a:b], int(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
