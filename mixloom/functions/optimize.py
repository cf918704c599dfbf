"""Small optimisers for driver-sized problems: L-BFGS, the simplex, and assignment."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def lbfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x0: np.ndarray, *, steps: int = 200, memory: int = 10, tol: float = 1e-8) -> tuple[np.ndarray, float]:
    """Minimises f (value, gradient) by limited-memory BFGS with backtracking; never returns a worse point than x0."""
    x = np.asarray(x0, float)
    value, grad = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, alphas = grad.copy(), []
        for s, y in reversed(past):
            a = (s @ q) / (y @ s)
            alphas.append(a)
            q -= a * y
        if past:
            s, y = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(alphas)):
            q += s * (a - (y @ q) / (y @ s))
        move = -q
        if move @ grad >= 0:
            move, past = -grad, []
        step, ok = 1.0, False
        for _ in range(40):
            new = x + step * move
            v, g = f(new)
            if np.isfinite(v) and v <= value + 1e-4 * step * (move @ grad):
                ok = True
                break
            step *= 0.5
        if not ok:
            break
        s, y = new - x, g - grad
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
        done = abs(value - v) <= tol * max(1.0, abs(value)) and np.abs(g).max() < 1e-3
        x, value, grad = new, v, g
        if done or np.abs(grad).max() < tol:
            break
    return x, value


def hungarian(cost: np.ndarray) -> list[tuple[int, int]]:
    """Row-column pairs of least total cost (shortest augmenting paths); rectangular tables are allowed."""
    cost = np.asarray(cost, float)
    if cost.shape[0] > cost.shape[1]:
        return sorted((a, b) for b, a in hungarian(cost.T))
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while True:
            used[j0] = True
            i0, delta, j1 = owner[j0], np.inf, 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = cost[i0 - 1, j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j])


def align_labels(true: np.ndarray, found: np.ndarray) -> np.ndarray:
    """``found`` renamed to agree with ``true`` as often as possible; labels left over get new numbers."""
    true, found = np.asarray(true), np.asarray(found)
    t, f = np.unique(true[true >= 0]), np.unique(found)
    table = np.array([[np.sum((true == a) & (found == b)) for b in f] for a in t])
    names = {int(f[j]): int(t[i]) for i, j in hungarian(-table)}
    spare = int(t.max()) + 1 if len(t) else 0
    for b in f:
        if int(b) not in names:
            names[int(b)] = spare
            spare += 1
    return np.array([names[int(x)] for x in found])


def simplex_map(counts: np.ndarray, topics: np.ndarray, *, alpha: float = 1.0, steps: int = 200, tol: float = 1e-8) -> np.ndarray:
    """MAP topic proportions of one document: maximises sum counts ln(topics^T pi) + (alpha - 1) sum ln pi
    by exponentiated gradient with backtracking. ``topics`` is K x U."""
    k = len(topics)
    pi = np.full(k, 1 / k)
    value = lambda p: float(counts @ np.log(p @ topics + 1e-300) + (alpha - 1) * np.log(p + 1e-300).sum())
    best, rate = value(pi), 1.0
    for _ in range(steps):
        grad = topics @ (counts / (pi @ topics + 1e-300)) + (alpha - 1) / (pi + 1e-12)
        grad = (grad - grad @ pi) / max(1.0, counts.sum())
        new = pi * np.exp(np.clip(rate * grad, -50, 50))
        new /= new.sum()
        v = value(new)
        if v >= best:
            gain, pi, best, rate = v - best, new, v, rate * 1.5
            if gain < tol:
                break
        else:
            rate *= 0.5
            if rate < 1e-8:
                break
    return pi


def sticks_objective(rho, omega, *, n_rows: float, gamma: float, pull: np.ndarray):
    """The part of a hierarchical Dirichlet process's bound that depends on its sticks, and its
    gradient in rho: ``n_rows`` Dirichlet rows share the weights, ``pull`` (K + 1 values) is the
    concentration times the sum of their expected log probabilities."""
    from mixloom.functions.numeric import stick_to_weights
    from mixloom.functions.special import digamma, gammaln, trigamma

    k = len(rho)
    a, b = rho * omega, (1 - rho) * omega
    wa, wb = n_rows + 1, n_rows * np.arange(k, 0, -1) + gamma
    both = digamma(a + b)
    e1, e0 = digamma(a) - both, digamma(b) - both
    beta = stick_to_weights(rho)
    c = gammaln(1 + gamma) - gammaln(1.0) - gammaln(gamma) - (gammaln(a + b) - gammaln(a) - gammaln(b))
    value = float(c.sum() + ((wa - a) * e1 + (wb - b) * e0).sum() + pull @ beta)
    later = np.cumsum((beta * pull)[::-1])[::-1]
    left = np.concatenate(([1.0], np.cumprod(1 - rho)))[:k]
    grad = omega * ((wa - a) * trigamma(a) - (wb - b) * trigamma(b)) + left * pull[:k] - later[1:] / (1 - rho)
    return value, grad


def best_sticks(rho, omega, **kw) -> np.ndarray:
    """Sticks that maximise ``sticks_objective``, omega fixed; found in logit space."""
    from mixloom.functions.numeric import inv_sigmoid, sigmoid

    def f(c):
        r = sigmoid(c)
        value, grad = sticks_objective(r, omega, **kw)
        return -value, -grad * r * (1 - r)

    return sigmoid(lbfgs(f, inv_sigmoid(rho))[0])


def first_sticks(k: int, n_rows: float, gamma: float) -> tuple[np.ndarray, np.ndarray]:
    """Sticks and their concentrations before any data is seen."""
    one, rest = n_rows + 1.0, n_rows * np.arange(k, 0, -1) + gamma
    return one / (one + rest), one + rest
