"""Generators of small datasets with known structure, for tests and examples."""

from __future__ import annotations

import numpy as np


def asterisk(n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Points of eight elongated Gaussians on the unit circle, weights 1, 2, 1, 2, ...: (X, labels)."""
    rng = np.random.RandomState(seed)
    w = np.array([1, 2] * 4, float)
    z = rng.choice(8, size=n, p=w / w.sum())
    angle = 2 * np.pi * np.arange(8) / 8
    along = rng.normal(scale=0.25, size=n)
    across = rng.normal(scale=0.03, size=n)
    c, s = np.cos(angle[z]), np.sin(angle[z])
    return np.column_stack([c + along * c - across * s, s + along * s + across * c]), z


def mixture(n: int, k: int, d: int, seed: int = 0, spread: float = 5.0) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.RandomState(seed)
    centres, z = rng.normal(scale=spread, size=(k, d)), rng.randint(k, size=n)
    return centres[z] + rng.normal(size=(n, d)), z


def bars(n_docs: int, *, side: int = 6, words: int = 100, mixed: bool = False, seed: int = 42) -> list[tuple[int, int, float]]:
    """(doc_id, word_id, word_count) of documents whose topics are the rows of a side x side square."""
    rng = np.random.RandomState(seed)
    v = side * side
    topics = np.full((side, v), 0.02 / v)
    for k in range(side):
        topics[k, k * side : (k + 1) * side] += 0.98 / side
    weights = np.linspace(2, 1, side)
    out = []
    for d in range(n_docs):
        pi = rng.dirichlet(np.full(side, 0.3)) if mixed else np.eye(side)[rng.choice(side, p=weights / weights.sum())]
        counts = rng.multinomial(words, pi @ topics)
        out += [(d, int(w), float(c)) for w, c in enumerate(counts) if c]
    return out


def sequences(n_seqs: int, k: int, d: int, length: int, seed: int = 0, stay: float = 0.9) -> list[tuple[int, int, list[float], int]]:
    """(seq_id, pos, x, state) of Gaussian Markov chains that mostly stay."""
    rng = np.random.RandomState(seed)
    centres = rng.normal(scale=4, size=(k, d))
    out = []
    for s in range(n_seqs):
        z = rng.randint(k)
        for t in range(length):
            if rng.rand() > stay:
                z = rng.randint(k)
            out.append((s, t, (centres[z] + rng.normal(size=d)).tolist(), int(z)))
    return out


def blocks(n: int, k: int, seed: int = 0, inside: float = 0.8, outside: float = 0.1) -> list[tuple[int, int, float]]:
    """(src, dst, x) of all ordered pairs, with more ones inside a community."""
    rng = np.random.RandomState(seed)
    return [(i, j, float(rng.rand() < (inside if i % k == j % k else outside))) for i in range(n) for j in range(n) if i != j]
