"""Word shingles of whole texts as 64-bit hashes, in numpy over batches of texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np

WORDS = 5
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, size=256, dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = int(_RNG.integers(1, 2**63)) | 1
_STEP = _RNG.integers(1, 2**63, size=WORDS + 1, dtype=np.uint64) | np.uint64(1)
_PIECE = 1 << 18
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: int, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        steps = np.full(max(n, _PIECE), base % 2**64, dtype=np.uint64)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name][:n]


def _hash_words(data: bytes, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of lower-cased bytes: a polynomial in a random odd base, wrapping at
    2**64. gap: which bytes lie between words."""
    a = np.frombuffer(data, dtype=np.uint8)
    word = np.concatenate(([False], ~gap[a], [False]))
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[a] * _power("up", _BASE, len(a)), dtype=np.uint64)))
    h = (total[end] - total[start]) * _power("down", pow(_BASE, -1, 2**64), len(a) + 1)[start]
    return mix(h + (end - start).astype(np.uint64)), start


def _pieces(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Cut at white space, so that no piece is long unless one word is."""
    at = 0
    while at < len(data):
        end = min(len(data), at + _PIECE)
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        yield at, data[at:end]
        at = end


def word_hashes(texts: Sequence[str | None], gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased, and where each text's begin."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    hashes, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for at, piece in _pieces(b" ".join(raw)):
        h, s = _hash_words(piece, gap)
        hashes.append(h)
        starts.append(s + at)
    bounds = np.searchsorted(np.concatenate(starts), np.cumsum([0] + [len(x) + 1 for x in raw]))
    return np.concatenate(hashes), bounds


def shingle_sets(texts: Sequence[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; of the whole sequence if it has fewer words; empty
    without words. A-Z is lower-cased, and words are what lies between ASCII white space."""
    w, bounds = word_hashes(texts)
    n = max(0, len(w) - words + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(words):
        rolled += w[k : k + n] * _STEP[k]
    rolled = mix(rolled)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= words:
            out.append(np.unique(rolled[lo : hi - words + 1]))
        elif hi > lo:
            out.append(mix((w[lo:hi] * _STEP[: hi - lo]).sum(dtype=np.uint64, keepdims=True) + _STEP[hi - lo]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(hashes: np.ndarray) -> bytes:
    """A 128-bit name for a set."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def minhashes(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The smallest product with each odd factor, its upper 32 bits."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[at : at + 2048, None] * factors).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)
