"""Word shingles as 64-bit hashes, for many texts at once."""

from __future__ import annotations

import numpy as np
import xxhash

from galena.llm.caches import register

SHINGLE_WORDS = 5
#: Hashes of so many words are remembered by a worker.
MEMO_WORDS = 200_000

_FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    """Words in lower case: runs of ASCII letters and digits and of what isn't ASCII."""
    return text.lower().encode().translate(_FOLD).split()


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()
register("words", _HASHES.clear)


def hashed(words: list[bytes]) -> np.ndarray:
    if len(_HASHES) > MEMO_WORDS:
        _HASHES.clear()
    return np.fromiter(map(_HASHES.__getitem__, words), "u8", len(words))


def node_of(words: list[bytes]) -> bytes:
    """128 bits that stand for a text's sequence of words."""
    return xxhash.xxh3_128_digest(b" ".join(words))


def multisets(texts: list[list[bytes]], k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, times) of all distinct shingles, sorted by text and within it by a hash.

    A text of fewer than ``k`` words, but not none, has one shingle of them all.
    """
    sizes = np.array([len(t) for t in texts], "i8")
    h = hashed([w for t in texts for w in t])
    counts = np.where(sizes == 0, 0, np.maximum(sizes - k + 1, 1))
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    width = np.minimum(sizes, k)[owner]
    padded = np.concatenate([h, np.zeros(k, "u8")])
    total = np.full(len(first), 0, "u8")
    for i in range(k):
        word = np.where(i < width, padded[first + i], np.uint64(i + 1))
        total = mix(total * _STEP + word)
    order = np.lexsort((total, owner))
    owner, total = owner[order], total[order]
    new = np.ones(len(total), bool)
    new[1:] = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], total[at], np.diff(np.append(at, len(total)))


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets (shingles sorted, times)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    shared = a[0][at] == b[0]
    both = int(np.minimum(a[1][at[shared]], b[1][shared]).sum())
    return both / (int(a[1].sum()) + int(b[1].sum()) - both)
