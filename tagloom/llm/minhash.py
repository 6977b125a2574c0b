"""MinHash signatures of token shingles, many texts at a time, and their bands."""

from __future__ import annotations

from hashlib import blake2b
from itertools import chain

import numpy as np

#: Words a shingle; values a signature; values a band. A pair of similarity 0.75 shares a band with 99.8 %, of 0.8 with 99.98 %.
SHINGLE, PERMS, ROWS = 5, 64, 4
CACHE_ENTRIES = 500_000


def token_id(token: str) -> int:
    return int.from_bytes(blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class TokenIds(dict):
    """Token -> a stable 64-bit id; a worker keeps so many at most."""

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        out = self[token] = token_id(token)
        return out


_ODD = np.random.default_rng(11).integers(1, 2**63, PERMS, dtype=np.uint64) | np.uint64(1)
_ADD = np.random.default_rng(12).integers(0, 2**63, PERMS, dtype=np.uint64)


def shingles(ids: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts one after the other, where those of each text with tokens start, and which texts these are.

    ``ids`` holds the token ids of all texts one after the other. Texts of fewer than SHINGLE tokens have one shingle, their padded tokens.
    """
    padded = np.where(lens > 0, np.maximum(lens, SHINGLE), 0)
    if padded.sum() != len(ids):
        wide = np.zeros(int(padded.sum()), np.uint64)
        starts = np.concatenate([[0], np.cumsum(padded)[:-1]])
        wide[np.repeat(starts - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(len(ids))] = ids
        ids = wide
    filled = padded > 0
    if not filled.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), filled
    m = len(ids) - SHINGLE + 1
    h = np.zeros(m, np.uint64)
    for j in range(SHINGLE):
        h = h * np.uint64(0x100000001B3) + ids[j : j + m]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    ends = np.cumsum(padded)[filled]
    starts = ends - padded[filled]
    inside = np.ones(m, bool)  # a shingle that reaches into the next text is none
    for j in range(1, SHINGLE):
        at = ends[:-1] - j
        inside[at[at < m]] = False
    kept = np.concatenate([[0], np.cumsum(inside)])
    return h[inside], kept[starts], filled


def distinct(ids: np.ndarray, n: int) -> np.ndarray:
    """The different shingles of one text, sorted."""
    return np.unique(shingles(ids, np.array([n], np.int64))[0])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of two sets of shingles."""
    both = np.intersect1d(a, b, assume_unique=True).size
    return both / max(1, len(a) + len(b) - both)


def signatures(ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """A row of PERMS values for each text, zeros for a text without tokens; ``ids`` as for ``shingles``."""
    return of_shingles(*shingles(ids, lens))


def of_shingles(h: np.ndarray, segments: np.ndarray, filled: np.ndarray) -> np.ndarray:
    out = np.zeros((len(filled), PERMS), np.uint32)
    if not len(h):
        return out
    for p in range(PERMS):
        out[filled, p] = np.minimum.reduceat((h * _ODD[p] + _ADD[p]) >> np.uint64(32), segments)
    return out


def bands(sig: np.ndarray, salt: int) -> np.ndarray:
    """PERMS / ROWS bucket numbers for each signature."""
    n = PERMS // ROWS
    out = np.zeros((len(sig), n), np.uint64)
    for b in range(n):
        h = np.full(len(sig), salt * n + b + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for r in range(ROWS):
            h = (h ^ sig[:, b * ROWS + r].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(31)
        out[:, b] = h
    return out.view(np.int64)


def flat(parts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lens = np.array([len(p) for p in parts], np.int64)
    return np.fromiter(chain.from_iterable(parts), np.uint64, int(lens.sum())), lens
