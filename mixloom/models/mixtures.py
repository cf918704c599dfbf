"""Allocation models of mixtures: finite and Dirichlet-process, and their joint objective."""

from __future__ import annotations

import numpy as np

from mixloom.functions.numeric import exp_normalise, greater_than_counts, r_log_r, top_l
from mixloom.functions.special import digamma, gammaln
from mixloom.models.likelihoods import Likelihood


#: Statistics of the whole, without a component axis.
WHOLE = ("evidence", "pair_entropy", "n")


def beta_cumulant(a, b):
    return gammaln(np.add(a, b)) - gammaln(a) - gammaln(b)


class FiniteMixture:
    """Symmetric Dirichlet over K components; ``gamma`` is the total concentration."""

    name = "FiniteMixture"

    def __init__(self, gamma: float = 1.0):
        self.gamma = gamma

    def prior_nat(self, k: int):
        return {"theta": np.full(k, self.gamma / k)}

    def increments(self, n):
        return {"theta": n}

    def log_weights(self, nat):
        return digamma(nat["theta"]) - digamma(nat["theta"].sum())

    def mean_weights(self, nat):
        return nat["theta"] / nat["theta"].sum()

    def objective(self, n, nat=None):
        k = len(n)
        prior, best = self.prior_nat(k)["theta"], self.prior_nat(k)["theta"] + n
        theta = best if nat is None else nat["theta"]
        c = lambda a: gammaln(a.sum()) - gammaln(a).sum()
        return float(c(prior) - c(theta) + ((best - theta) * self.log_weights({"theta": theta})).sum())

    def em_weights(self, n):
        """MAP weights; a weight below zero is an error (gamma too small for maximum a posteriori)."""
        w = n + self.gamma / len(n) - 1
        if self.gamma / len(n) >= 1:
            if (w < 0).any():
                raise ValueError("negative mixture weight")
        else:  # maximum likelihood
            w = np.array(n, float)
        return w / w.sum()

    def em_log_prior(self, w):
        return float((max(self.gamma / len(w), 1.0) - 1) * np.log(w + 1e-100).sum())


class DPMixture:
    """Dirichlet-process mixture by truncated stick breaking with Beta(gamma1, gamma0) sticks."""

    name = "DPMixture"

    def __init__(self, gamma0: float = 1.0, gamma1: float = 1.0):
        self.gamma0, self.gamma1 = gamma0, gamma1

    def prior_nat(self, k):
        return {"eta1": np.full(k, float(self.gamma1)), "eta0": np.full(k, float(self.gamma0))}

    def increments(self, n):
        return {"eta1": n, "eta0": greater_than_counts(n)}

    @staticmethod
    def _elogs(nat):
        both = digamma(nat["eta1"] + nat["eta0"])
        return digamma(nat["eta1"]) - both, digamma(nat["eta0"]) - both

    def log_weights(self, nat):
        e1, e0 = self._elogs(nat)
        return e1 + np.concatenate(([0.0], np.cumsum(e0)[:-1]))

    def mean_weights(self, nat):
        u = nat["eta1"] / (nat["eta1"] + nat["eta0"])
        return u * np.concatenate(([1.0], np.cumprod(1 - u)[:-1]))

    def objective(self, n, nat=None):
        prior, inc = self.prior_nat(len(n)), self.increments(n)
        best = {k: prior[k] + inc[k] for k in prior}
        nat = best if nat is None else nat
        e1, e0 = self._elogs(nat)
        slack = (best["eta1"] - nat["eta1"]) * e1 + (best["eta0"] - nat["eta0"]) * e0
        return float((beta_cumulant(prior["eta1"], prior["eta0"]) - beta_cumulant(nat["eta1"], nat["eta0"]) + slack).sum())


class Mixture:
    """An allocation model with a likelihood: local step, statistics, global step, objective."""

    def __init__(self, alloc: FiniteMixture | DPMixture, obs: Likelihood):
        self.alloc, self.obs = alloc, obs
        self.name = f"{alloc.name} x {obs.name}"

    def global_step(self, stats):
        k = len(stats["N"])
        prior, inc = self.alloc.prior_nat(k), self.alloc.increments(stats["N"])
        return {"alloc": {p: prior[p] + inc[p] for p in prior}, "obs": self.obs.nat(stats)}

    def stochastic_step(self, params, stats, rate, factor):
        """Weighted average of the old natural parameters and those of the amplified batch."""
        new = self.global_step({k: v * factor for k, v in stats.items() if k not in ("entropy", *WHOLE)})
        if params is None:
            return new
        return {part: {k: (1 - rate) * params[part][k] + rate * new[part][k] for k in new[part]} for part in new}

    def scorer(self, params):
        """A function batch -> N x K log weights plus expected log likelihoods."""
        log_w, post, obs = self.alloc.log_weights(params["alloc"]), self.obs.post(params["obs"]), self.obs
        return lambda batch: obs.score(batch, post) + log_w

    def em_scorer(self, params):
        log_w, obs, em = np.log(params["weights"] + 1e-100), self.obs, params["em"]
        return lambda batch: obs.em_score(batch, em) + log_w

    def em_step(self, stats):
        return {"weights": self.alloc.em_weights(stats["N"]), "em": self.obs.em(stats)}

    def summary(self, batch, scores, keep: int | None = None, pairs: list[tuple[int, int]] = ()):
        """Statistics of one batch, with entropies; ``pairs`` adds the entropies of merged pairs."""
        resp, norm = exp_normalise(scores)
        if keep:
            resp = top_l(resp, keep)
        out = self.obs.stats(batch, resp) | {"entropy": r_log_r(resp), "evidence": np.array([norm.sum()])}
        if pairs:
            out["pair_entropy"] = np.array([r_log_r((resp[:, a] + resp[:, b])[:, None])[0] for a, b in pairs])
        return out

    def objective(self, stats, params=None):
        """The evidence lower bound; ``params`` None means those that belong to ``stats``."""
        return self.alloc.objective(stats["N"], params and params["alloc"]) + self.obs.objective(stats, params and params["obs"]) + float(stats["entropy"].sum())

    def scale(self, n):
        return self.obs.scale(n)


def remove_components(stats: dict, drop: list[int], k: int) -> dict:
    """Statistics without some components; only arrays whose first axis is K are touched."""
    keep = [i for i in range(k) if i not in set(drop)]
    return {name: v[keep] if name not in WHOLE else v for name, v in stats.items()}


def merge_components(stats: dict, a: int, b: int, pair_entropy: float | None = None) -> dict:
    """Component b added to a and removed. The entropy of the pair is exact if given, else the sum,
    which bounds it from above."""
    out = {}
    k = len(stats["N"])
    for name, v in stats.items():
        if name in WHOLE:
            out[name] = v
            continue
        v = v.copy()
        v[a] = pair_entropy if name == "entropy" and pair_entropy is not None else v[a] + v[b]
        out[name] = v[[i for i in range(k) if i != b]]
    return out


def reorder_components(stats: dict, order) -> dict:
    return {name: v if name in WHOLE else v[order] for name, v in stats.items()}
