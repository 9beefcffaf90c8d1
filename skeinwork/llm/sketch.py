"""SetSketch registers of shingle sets: exponentially spaced, truncated minima (Ertl, 2021).

Register i of a set is ``floor(1 - log_b(min x_i))`` over its elements, truncated to 0..Q + 1, where x_i are
exponential hash values of rate A. Registers of a union are the larger of the registers, so sketches merge, and
two registers agree with about the probability of the Jaccard similarity.
"""

from __future__ import annotations

import numpy as np

from skeinwork.llm import _text as tx

BASE, RATE, TOP = 1.001, 20.0, 65534
_rng = np.random.default_rng(777)
_MULT = _rng.integers(0, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEED = _rng.integers(0, 2**63, 4096, dtype=np.uint64)


def shingle_sets(words: tx.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document, sorted by document and value, and where each document's begin.

    A document of fewer words is one shingle; one without words has none.
    """
    counts = words.counts()
    start, of = words.runs(size)
    value = tx.rolling(words.hashes, size)[start]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.array([tx.rolling(words.hashes[words.first[i] : words.first[i + 1]], int(counts[i]))[0] for i in short], dtype=np.uint64)
        value, of = np.concatenate([value, whole * (2 * counts[short] + 1).astype(np.uint64)]), np.concatenate([of, short])
    value = tx.mix(value)
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    value, of = value[new], of[new]
    return value, np.searchsorted(of, np.arange(len(counts) + 1))


def registers(value: np.ndarray, begin: np.ndarray, m: int) -> np.ndarray:
    """uint16 registers, one row for each non-empty set of ``shingle_sets``."""
    full = np.flatnonzero(np.diff(begin))
    low = np.empty((len(full), m), dtype=np.uint64)
    if len(full):
        hashed = np.empty_like(value)
        for i in range(m):
            np.multiply(value, _MULT[i], out=hashed)
            np.bitwise_xor(hashed, _SEED[i], out=hashed)
            low[:, i] = np.minimum.reduceat(hashed, begin[full])
    x = -np.log1p(-((low >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def band_keys(regs: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` registers, of each sketch."""
    bands = regs.shape[1] // rows
    key = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    key = np.repeat(key, len(regs), axis=0)
    parts = regs[:, : bands * rows].reshape(len(regs), bands, rows)
    for r in range(rows):
        key = tx.mix(key ^ parts[:, :, r].astype(np.uint64)) + np.uint64(r)
    return key


def may_be_similar(equal: np.ndarray, above: np.ndarray, below: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, similarity: float, slack: float = 11.0) -> np.ndarray:
    """Joint likelihood of both sketches, given the sizes of the sets: False where ``similarity`` or more is implausible.

    ``equal``, ``above`` and ``below`` count the registers of a that are equal to, above and below those of b. The
    likelihood ratio against the best value must be over exp(-slack); 11 is about 4.7 standard deviations, a miss of one in a million.
    """
    u = n_a / (n_a + n_b)
    v = 1 - u
    highest = np.minimum(u / v, v / u)

    def log_likelihood(j: np.ndarray) -> np.ndarray:
        p = lambda x: -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)
        up, down = p(u - v * j), p(v - u * j)
        same = np.maximum(1 - up - down, 1e-12)
        return above * np.log(np.maximum(up, 1e-12)) + below * np.log(np.maximum(down, 1e-12)) + equal * np.log(same)

    # The likelihood is unimodal in the similarity, so its best value over [similarity, highest] tells enough.
    best_any = np.max([log_likelihood(highest * t) for t in np.linspace(0.02, 1, 50)], axis=0)
    best_in = np.max([log_likelihood(np.minimum(similarity, highest) + (highest - np.minimum(similarity, highest)) * t) for t in np.linspace(0, 1, 12)], axis=0)
    return (highest >= similarity - 1e-9) & (best_in >= np.maximum(best_any, best_in) - slack)
