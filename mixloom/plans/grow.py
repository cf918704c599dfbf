"""Moves for topic and hidden Markov models: merge, delete, birth and reorder, judged by a full pass.

These models' local steps are iterative, so a move has no closed-form gain: the changed
parameters are scored over all rows once, the global step is taken, and the move stays if the
objective of the whole rises. A pass is one job, so moves cost as many jobs as are tried.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from mixloom.functions.numeric import big_to_small, stick_to_weights, weights_to_stick
from mixloom.models.hmm import HMM
from mixloom.models.topics import TopicModel
from mixloom.plans.fit import FitResult, merge_shortlist


def _sticks(params: dict, beta: np.ndarray) -> dict:
    """Sticks for changed weights (K + 1 values); concentrations keep their mean."""
    omega = np.full(len(beta) - 1, float(np.mean(params["omega"])))
    return {"rho": weights_to_stick(beta), "omega": omega}


def _weights(params: dict) -> np.ndarray | None:
    return stick_to_weights(params["rho"]) if params.get("rho") is not None else None


class _Topics:
    """How the parameters of a topic model change."""

    def __init__(self, model: TopicModel):
        self.model = model

    def size(self, params):
        return len(params["lam"])

    def _with(self, params, lam, beta):
        return {"lam": lam} | (_sticks(params, beta) if beta is not None else {})

    def merged(self, params, a, b):
        lam, beta = params["lam"].copy(), _weights(params)
        lam[a] += lam[b] - self.model.obs.lam0
        if beta is not None:
            beta[a] += beta[b]
            beta = np.delete(beta, b)
        return self._with(params, np.delete(lam, b, 0), beta)

    def removed(self, params, k):
        beta = _weights(params)
        if beta is not None:
            beta = np.delete(beta, k)
            beta /= beta.sum()
        return self._with(params, np.delete(params["lam"], k, 0), beta)

    def grown(self, params, row, k):
        """A topic from one document, in front of the rest; it takes half of topic k's weight."""
        fresh = np.full(params["lam"].shape[1], 0.0) + self.model.obs.lam0
        np.add.at(fresh, np.asarray(row["ids"]), 10 * np.asarray(row["counts"], float))
        beta = _weights(params)
        if beta is not None:
            half = beta[k] / 2
            beta[k] = half
            beta = np.insert(beta, len(beta) - 1, half)
        return self._with(params, np.vstack([params["lam"], fresh]), beta)

    def ordered(self, params, order):
        beta = _weights(params)
        if beta is not None:
            beta = np.append(beta[order], beta[-1])
        return self._with(params, params["lam"][order], beta)

    def scale(self, stats):
        return float(stats["tokens"][0])

    key = "doc_id"


class _States:
    """How the parameters of a hidden Markov model change: rows and columns of transitions together."""

    def __init__(self, model: HMM):
        self.model = model

    def size(self, params):
        return len(params["trans"])

    def _with(self, params, obs, start, trans, beta):
        return {"obs": obs, "start": start, "trans": trans} | (_sticks(params, beta) if beta is not None else {})

    def merged(self, params, a, b):
        prior, beta = self.model.obs.prior(), _weights(params)
        obs = {k: v.copy() for k, v in params["obs"].items()}
        for k, v in obs.items():
            v[a] = v[a] + v[b] - prior[k]
        obs = {k: np.delete(v, b, 0) for k, v in obs.items()}
        start, trans = params["start"].copy(), params["trans"].copy()
        start[a] += start[b]
        trans[a] += trans[b]
        trans[:, a] += trans[:, b]
        if beta is not None:
            beta[a] += beta[b]
            beta = np.delete(beta, b)
        return self._with(params, obs, np.delete(start, b), np.delete(np.delete(trans, b, 0), b, 1), beta)

    def removed(self, params, k):
        beta = _weights(params)
        if beta is not None:
            beta = np.delete(beta, k)
            beta /= beta.sum()
        obs = {n: np.delete(v, k, 0) for n, v in params["obs"].items()}
        return self._with(params, obs, np.delete(params["start"], k), np.delete(np.delete(params["trans"], k, 0), k, 1), beta)

    def grown(self, params, row, k):
        """A state from the first half of one sequence, with state k's transitions shared."""
        n = max(1, row["n"] // 2)
        batch = {c: np.asarray(row[c], float).reshape(row["n"], -1)[:n] for c in ("x", "xprev") if c in row.asDict()}
        one = self.model.obs.nat(self.model.obs.stats(batch, np.ones((n, 1))))
        obs = {name: np.concatenate([v, one[name]]) for name, v in params["obs"].items()}
        at, beta = self.size(params), _weights(params)
        start = np.insert(params["start"], at, params["start"][k] / 2)
        trans = np.insert(params["trans"], at, params["trans"][:, k] / 2, axis=1)
        trans = np.vstack([trans, trans[k]])
        if beta is not None:
            half = beta[k] / 2
            beta[k] = half
            beta = np.insert(beta, len(beta) - 1, half)
        return self._with(params, obs, start, trans, beta)

    def ordered(self, params, order):
        beta, k = _weights(params), self.size(params)
        if beta is not None:
            beta = np.append(beta[order], beta[-1])
        wide = [*order, *range(k, params["trans"].shape[1])]
        return self._with(params, {n: v[order] for n, v in params["obs"].items()}, params["start"][wide], params["trans"][order][:, wide], beta)

    def scale(self, stats):
        return self.model.obs.scale(float(stats["n"][0]))

    key = "seq_id"


@dataclass
class Grow:
    """Which moves are tried after each lap, and how many."""

    merge: int = 3
    delete: int = 1
    birth: int = 1
    reorder: bool = True
    k_max: int = 100
    refine: int = 2


def fit_grow(rows: DataFrame, model: TopicModel | HMM, first: FitResult, *, laps: int = 3, moves: Grow | None = None, seed: int = 0) -> FitResult:
    """Continues a fit with moves after each lap. The loss never rises; components keep uids.

    ``rows`` are documents or sequences as rows; ``first`` is a result of ``fit_topics`` or
    ``fit_hmm``.
    """
    from mixloom.plans.fit import draw_rows

    moves, change = moves or Grow(), _States(model) if isinstance(model, HMM) else _Topics(model)
    params, uids = first.params, list(first.uids)
    fresh_uid, result = max(uids) + 1, FitResult({}, {})

    def settle(start, rounds=1):
        """Passes under changed parameters: (objective, statistics, parameters)."""
        now = start
        for _ in range(rounds):
            stats = model.lap(rows, now)
            now = model.global_step(stats, now)
        return model.objective(stats, now), stats, now

    best, stats, params = settle(params)
    for lap in range(1, laps + 1):
        after = settle(params)
        if after[0] >= best:
            best, stats, params = after
        log = lambda kind, ok, who: result.moves.append({"lap": lap, "move": kind, "accepted": bool(ok), "uids": tuple(who)})  # noqa: E731, B023
        for _ in range(moves.birth):
            if change.size(params) >= moves.k_max:
                break
            drawn = draw_rows(rows, change.key, 1, seed + 97 * lap)
            if not drawn:
                break
            k = int(np.argmax(stats["N"]))
            trial = settle(change.grown(params, drawn[0], k), moves.refine)
            ok = trial[0] > best
            log("birth", ok, [uids[k]])
            if ok:
                best, stats, params = trial
                uids.append(fresh_uid)
                fresh_uid += 1
        for _ in range(moves.delete):
            if change.size(params) < 2:
                break
            k = int(np.argmin(stats["N"]))
            trial = settle(change.removed(params, k), moves.refine)
            ok = trial[0] > best
            log("delete", ok, [uids[k]])
            if ok:
                best, stats, params = trial
                uids.pop(k)
        for a, b in merge_shortlist(stats["N"], 1)[: moves.merge]:
            if b >= change.size(params):
                continue
            trial = settle(change.merged(params, a, b), moves.refine)
            ok = trial[0] > best
            log("merge", ok, [uids[a], uids[b]])
            if ok:
                best, stats, params = trial
                uids.pop(b)
                break  # the others were planned for the components before
        if moves.reorder:
            order = big_to_small(stats["N"])
            if (order != np.arange(len(order))).any():
                trial = settle(change.ordered(params, order))
                ok = trial[0] > best
                log("shuffle", ok, uids)
                if ok:
                    best, stats, params = trial
                    uids = [uids[i] for i in order]
        result.trace.append({"lap": lap, "loss": float(-best / change.scale(stats)), "k": change.size(params)})
    result.params, result.stats, result.uids = params, stats, uids
    return result
