"""Sets of word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Entries that a task's table of word hashes holds at most; it starts anew beyond that.
WORDS = 300_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ x >> np.uint64(30)) * _A
    x = (x ^ x >> np.uint64(27)) * _B
    return x ^ x >> np.uint64(31)


class WordHashes(dict):
    """Hash of each word, computed when first met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _rolled(h: np.ndarray, width: int) -> np.ndarray:
    out = np.full(max(0, len(h) - width + 1), width, np.uint64)
    for k in range(width):
        out = mixed(out + h[k : len(h) - width + 1 + k])
    return out


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) > 1 else x


def shingle_sets(texts: list[str | None], size: int, known: WordHashes) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``size`` words.

    A-Z count as a-z; words are runs of characters other than space and U+0009 to U+000D. A text of fewer words has one
    shingle, all of them; null, empty and blank texts have none.
    """
    words = [(t or "").encode().lower().split() for t in texts]
    lengths = [len(w) for w in words]
    h = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.uint64, sum(lengths))
    # One pass over the words of all texts; shingles that span two texts are left out below.
    every, out, at = _rolled(h, size), [], 0
    for n in lengths:
        out.append(_distinct(every[at : at + n - size + 1]) if n >= size else _rolled(h[at : at + n], n) if n else h[:0])
        at += n
    return out


def shingle_set(text: str | None, size: int, known: WordHashes) -> np.ndarray:
    return shingle_sets([text], size, known)[0]
