"""Word shingles and one-permutation MinHash signatures, computed with numpy on whole texts.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` of the UTF-8 text with A-Z lower-cased.  A shingle is
`width` consecutive words; a text with fewer words has its whole word sequence as the only shingle; a text without words
has an empty set.  Shingles are held as 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import xxhash

MASK = (1 << 64) - 1


class WordHashes(dict):
    """Word -> 64-bit hash, remembered up to `limit` words and then started anew (memory stays bounded)."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums of products end up evenly spread."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


#: One odd multiplier for each place in a shingle (and for each value of a band).
PLACES = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def word_list(text: str | None) -> list[bytes]:
    """bytes.split() cuts at exactly the six ASCII blanks of the definition; bytes.lower() touches A-Z only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` words (all of them where fewer)."""
    n = len(words)
    if n == 0:
        return words
    width = min(width, n)
    total = words[: n - width + 1] * PLACES[0]
    for k in range(1, width):
        total = total + mix(words[k : n - width + 1 + k]) * PLACES[k]
    return mix(total + np.uint64(width))


def shingle_set(text: str | None, hashes: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of one whole text."""
    words = word_list(text)
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), width))


class OnePermutation:
    """One-permutation MinHash of `bands * rows` bins, densified by random donor bins.

    The top bits of a shingle's hash choose its bin, so in a sorted set each bin is one run whose first element is its
    minimum.  An empty bin copies the first non-empty bin in its own fixed random order of all bins: the donor does not
    depend on where the other empty bins lie (optimal densification), and the search always ends.
    """

    FEW = 16

    def __init__(self, bands: int = 32, rows: int = 4, seed: int = 20250101):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        bits = self.bins.bit_length() - 1
        if 1 << bits != self.bins:
            raise ValueError("bands * rows must be a power of two")
        self.edges = np.arange(self.bins, dtype=np.uint64) << np.uint64(64 - bits)
        rng = np.random.default_rng(seed)
        self.donors = np.argsort(rng.random((self.bins, self.bins)), axis=1)
        self.salt = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def signature(self, sorted_set: np.ndarray) -> np.ndarray:
        """The `bins` densified minima of a non-empty sorted set."""
        start = np.searchsorted(sorted_set, self.edges)
        end = np.append(start[1:], len(sorted_set))
        full = end > start
        values = sorted_set[np.minimum(start, len(sorted_set) - 1)]
        if not full.all():
            empty = np.flatnonzero(~full)
            for tries in (self.FEW, self.bins):  # few donors do for nearly all bins; the rest look through all of them
                order = self.donors[empty, :tries]
                at = full[order].argmax(axis=1)
                donor = order[np.arange(len(empty)), at]
                found = full[donor]
                values[empty[found]] = values[donor[found]]
                empty = empty[~found]
        return values

    def band_keys(self, sorted_set: np.ndarray) -> np.ndarray:
        """One signed 64-bit bucket key for each band."""
        rows = mix(self.signature(sorted_set)).reshape(self.bands, self.rows) * PLACES[: self.rows]
        return mix(rows.sum(axis=1, dtype=np.uint64) ^ self.salt).view(np.int64)
