"""Conjugate likelihoods in natural form.

Each family keeps, per component, natural parameters ``nat``: prior plus additive statistics, so
merging components, forgetting a batch, and stochastic averaging are plain arithmetic. A family
defines
  stats(batch, resp)   additive statistics of responsibility-weighted rows (K first),
  prior(...)           natural parameters of the prior,
  post(nat)            named posterior parameters,
  eta(post)            expected natural statistics, same keys as ``nat``,
  cumulant(post)       minus the log partition function, per component,
  score(batch, post)   N x K expected log likelihood, and
  em(stats), em_score  point estimates and their log likelihood.
A batch is a dict of numpy arrays: x, and where needed xprev, y.
"""

from __future__ import annotations

import math

import numpy as np

from mixloom.functions.special import LOG_2PI, digamma, gammaln, multigammaln

Arrays = dict[str, np.ndarray]


def _outer_sum(resp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """K x Da x Db weighted sums of outer products, one matrix product per component."""
    return np.stack([(a * r[:, None]).T @ b for r in resp.T])


class Likelihood:
    name = ""

    def stats(self, batch: Arrays, resp: np.ndarray) -> Arrays:
        raise NotImplementedError

    def nat(self, stats: Arrays) -> Arrays:
        """Prior plus statistics."""
        inc, prior = self.increments(stats), self.prior()
        return {k: prior[k] + inc[k] for k in prior}

    def base(self, stats: Arrays) -> float:
        """The part of the expected log likelihood that no parameter touches."""
        return 0.0

    def objective(self, stats: Arrays, nat: Arrays | None = None) -> float:
        """Expected log likelihood minus the divergence from the prior, for any posterior ``nat``
        (default: the one that belongs to ``stats``)."""
        best = self.nat(stats)
        nat = best if nat is None else nat
        post, prior = self.post(nat), self.post({k: v[None] for k, v in self.prior().items()})
        total = float(np.sum(self.cumulant(prior)[0] - self.cumulant(post))) + self.base(stats)
        eta = self.eta(post)
        return total + sum(float(np.sum((best[k] - nat[k]) * eta[k])) for k in best)

    def merge_gap(self, stats: Arrays, a: int, b: int) -> float:
        """Change of ``objective`` when components a and b become one; entropy not included."""
        one = lambda s: self.cumulant(self.post(self.nat(s)))[0]
        pick = lambda i: {k: v[i : i + 1] for k, v in stats.items()}
        prior = self.cumulant(self.post({k: v[None] for k, v in self.prior().items()}))[0]
        both = {k: v[a : a + 1] + v[b : b + 1] for k, v in stats.items()}
        return float(one(pick(a)) + one(pick(b)) - prior - one(both))

    def log_marginal(self, stats: Arrays) -> np.ndarray:
        """Log marginal likelihood per component, up to the base measure."""
        prior = self.cumulant(self.post({k: v[None] for k, v in self.prior().items()}))[0]
        return prior - self.cumulant(self.post(self.nat(stats)))


class DiagGauss(Likelihood):
    """Normal-Gamma per dimension."""

    name = "DiagGauss"

    def __init__(self, dim: int, *, nu: float | None = None, kappa: float = 1e-4, mean=0.0, var=1.0, s: float = 1.0, min_var: float = 1e-8):
        self.dim, self.min_var = dim, min_var
        self.nu0 = max(nu or 0, dim + 2.0)
        self.kappa0, self.m0 = max(kappa, 1e-8), np.broadcast_to(np.asarray(mean, float), (dim,))
        self.beta0 = np.broadcast_to(np.asarray(var, float) * s, (dim,)) * (self.nu0 - 2)

    def scale(self, n: float) -> float:
        return n * self.dim

    def stats(self, batch, resp):
        x = batch["x"]
        return {"N": resp.sum(0), "x": resp.T @ x, "xx": resp.T @ (x * x)}

    def increments(self, s):
        return {"nu": s["N"], "kappa": s["N"], "x": s["x"], "xx": s["xx"]}

    def prior(self):
        return {"nu": np.asarray(self.nu0), "kappa": np.asarray(self.kappa0), "x": self.kappa0 * self.m0, "xx": self.beta0 + self.kappa0 * self.m0**2}

    def post(self, nat):
        m = nat["x"] / nat["kappa"][..., None]
        return {"nu": nat["nu"], "kappa": nat["kappa"], "m": m, "beta": np.maximum(nat["xx"] - nat["kappa"][..., None] * m * m, 1e-300)}

    def eta(self, p):
        prec = p["nu"][:, None] / p["beta"]
        elog = digamma(p["nu"] / 2)[:, None] - np.log(p["beta"] / 2)
        return {"nu": 0.5 * elog.sum(1), "kappa": -0.5 * (self.dim / p["kappa"] + (prec * p["m"] ** 2).sum(1)), "x": prec * p["m"], "xx": -0.5 * prec}

    def cumulant(self, p):
        nu = p["nu"][:, None]
        return (-nu / 2 * math.log(2) - gammaln(nu / 2) + 0.5 * np.log(p["kappa"])[:, None] + nu / 2 * np.log(p["beta"])).sum(1)

    def base(self, s):
        return -0.5 * self.dim * LOG_2PI * float(s["N"].sum())

    def score(self, batch, p):
        x, e = batch["x"], self.eta(p)
        return x @ e["x"].T + (x * x) @ e["xx"].T + (e["nu"] + e["kappa"]) - 0.5 * self.dim * LOG_2PI

    def em(self, s):
        n = np.maximum(s["N"], 1e-300)[:, None]
        mu = s["x"] / n
        return {"mu": mu, "var": np.maximum(s["xx"] / n - mu * mu, 0) + self.min_var}

    def em_score(self, batch, p):
        x, w = batch["x"], 1 / p["var"]
        quad = (x * x) @ w.T - 2 * x @ (w * p["mu"]).T + (w * p["mu"] ** 2).sum(1)
        return -0.5 * (self.dim * LOG_2PI + np.log(p["var"]).sum(1) + quad)

    def divergence(self, batch, stats):
        """Bregman divergence of each row to each component's smoothed mean and variance."""
        p = self.post(self.nat(stats))
        var = p["beta"] / p["nu"][:, None]
        return np.maximum(-self.em_score(batch, {"mu": p["m"], "var": var}) - 0.5 * (self.dim * LOG_2PI + np.log(var).sum(1)), 0)


class _Wishart(Likelihood):
    """Shared algebra of the full-covariance families."""

    def __init__(self, dim: int, *, nu: float | None, cov, s: float, min_covar: float):
        self.dim, self.min_covar = dim, min_covar
        self.nu0 = max(nu or 0, dim + 2.0)
        c = np.asarray(cov, float)
        self.b0 = (np.diag(np.broadcast_to(c, (dim,))) if c.ndim < 2 else c) * s * (self.nu0 - dim - 1)

    def scale(self, n):
        return n * self.dim

    def base(self, s):
        return -0.5 * self.dim * LOG_2PI * float(s["N"].sum())

    def elogdet(self, p):
        halves = (p["nu"][:, None] + 1 - np.arange(1, self.dim + 1)) / 2
        return digamma(halves).sum(1) + self.dim * math.log(2) - np.linalg.slogdet(p["B"])[1]

    def wishart_cumulant(self, p):
        nu = p["nu"]
        return -nu * self.dim / 2 * math.log(2) - multigammaln(nu / 2, self.dim) + nu / 2 * np.linalg.slogdet(p["B"])[1]

    @staticmethod
    def quad(diff: np.ndarray, b: np.ndarray) -> np.ndarray:
        low = np.linalg.cholesky(b)
        return (np.linalg.solve(low, diff.T) ** 2).sum(0)


class Gauss(_Wishart):
    """Normal-Wishart."""

    name = "Gauss"

    def __init__(self, dim: int, *, nu=None, kappa=1e-4, mean=0.0, cov=1.0, s=1.0, min_covar=1e-8):
        super().__init__(dim, nu=nu, cov=cov, s=s, min_covar=min_covar)
        self.kappa0, self.m0 = max(kappa, 1e-8), np.broadcast_to(np.asarray(mean, float), (dim,))

    def stats(self, batch, resp):
        x = batch["x"]
        return {"N": resp.sum(0), "x": resp.T @ x, "xxT": _outer_sum(resp, x, x)}

    def increments(self, s):
        return {"nu": s["N"], "kappa": s["N"], "x": s["x"], "xxT": s["xxT"]}

    def prior(self):
        return {"nu": np.asarray(self.nu0), "kappa": np.asarray(self.kappa0), "x": self.kappa0 * self.m0, "xxT": self.b0 + self.kappa0 * np.outer(self.m0, self.m0)}

    def post(self, nat):
        m = nat["x"] / nat["kappa"][..., None]
        b = nat["xxT"] - nat["kappa"][..., None, None] * m[..., :, None] * m[..., None, :]
        return {"nu": nat["nu"], "kappa": nat["kappa"], "m": m, "B": 0.5 * (b + np.swapaxes(b, -1, -2))}

    def eta(self, p):
        w = p["nu"][:, None, None] * np.linalg.inv(p["B"])
        wm = np.einsum("kij,kj->ki", w, p["m"])
        return {"nu": 0.5 * self.elogdet(p), "kappa": -0.5 * (self.dim / p["kappa"] + (wm * p["m"]).sum(1)), "x": wm, "xxT": -0.5 * w}

    def cumulant(self, p):
        return self.wishart_cumulant(p) + self.dim / 2 * np.log(p["kappa"])

    def score(self, batch, p):
        x = batch["x"]
        flat = 0.5 * self.elogdet(p) - 0.5 * self.dim * LOG_2PI - 0.5 * self.dim / p["kappa"]
        return np.stack([f - 0.5 * nu * self.quad(x - m, b) for f, nu, m, b in zip(flat, p["nu"], p["m"], p["B"])], axis=1)

    def em(self, s):
        n = np.maximum(s["N"], 1e-300)
        mu = s["x"] / n[:, None]
        return {"mu": mu, "cov": s["xxT"] / n[:, None, None] - mu[:, :, None] * mu[:, None, :] + self.min_covar * np.eye(self.dim)}

    def em_score(self, batch, p):
        return np.stack([-0.5 * (self.dim * LOG_2PI + np.linalg.slogdet(c)[1] + self.quad(batch["x"] - m, c)) for m, c in zip(p["mu"], p["cov"])], axis=1)

    def divergence(self, batch, stats):
        p = self.post(self.nat(stats))
        return np.stack([0.5 * self.quad(batch["x"] - m, b / nu) for nu, m, b in zip(p["nu"], p["m"], p["B"])], axis=1)


class ZeroMeanGauss(_Wishart):
    """Wishart, mean fixed at zero."""

    name = "ZeroMeanGauss"

    def __init__(self, dim: int, *, nu=None, cov=1.0, s=1.0, min_covar=1e-8):
        super().__init__(dim, nu=nu, cov=cov, s=s, min_covar=min_covar)

    def stats(self, batch, resp):
        return {"N": resp.sum(0), "xxT": _outer_sum(resp, batch["x"], batch["x"])}

    def increments(self, s):
        return {"nu": s["N"], "xxT": s["xxT"]}

    def prior(self):
        return {"nu": np.asarray(self.nu0), "xxT": self.b0}

    def post(self, nat):
        return {"nu": nat["nu"], "B": nat["xxT"]}

    def eta(self, p):
        return {"nu": 0.5 * self.elogdet(p), "xxT": -0.5 * p["nu"][:, None, None] * np.linalg.inv(p["B"])}

    def cumulant(self, p):
        return self.wishart_cumulant(p)

    def score(self, batch, p):
        flat = 0.5 * self.elogdet(p) - 0.5 * self.dim * LOG_2PI
        return np.stack([f - 0.5 * nu * self.quad(batch["x"], b) for f, nu, b in zip(flat, p["nu"], p["B"])], axis=1)

    def em(self, s):
        return {"cov": s["xxT"] / np.maximum(s["N"], 1e-300)[:, None, None] + self.min_covar * np.eye(self.dim)}

    def em_score(self, batch, p):
        return np.stack([-0.5 * (self.dim * LOG_2PI + np.linalg.slogdet(c)[1] + self.quad(batch["x"], c)) for c in p["cov"]], axis=1)

    def divergence(self, batch, stats):
        p = self.post(self.nat(stats))
        return np.stack([0.5 * self.quad(batch["x"], b / nu) + 0.5 * np.linalg.slogdet(b / nu)[1] for nu, b in zip(p["nu"], p["B"])], axis=1)


class AutoRegGauss(_Wishart):
    """First-order autoregression, Matrix-Normal-Wishart; batches have ``xprev``."""

    name = "AutoRegGauss"

    def __init__(self, dim: int, *, dim_prev: int | None = None, nu=None, cov=1.0, v=1.0, m=None, s=1.0, min_covar=1e-8):
        super().__init__(dim, nu=nu, cov=cov, s=s, min_covar=min_covar)
        e = dim_prev or dim
        self.v0 = np.eye(e) * v
        self.m0 = np.eye(dim, e) if m is None else np.asarray(m, float)

    def stats(self, batch, resp):
        x, p = batch["x"], batch["xprev"]
        return {"N": resp.sum(0), "xxT": _outer_sum(resp, x, x), "ppT": _outer_sum(resp, p, p), "pxT": _outer_sum(resp, p, x)}

    def increments(self, s):
        return {"nu": s["N"], "xxT": s["xxT"], "ppT": s["ppT"], "pxT": s["pxT"]}

    def prior(self):
        return {"nu": np.asarray(self.nu0), "xxT": self.b0 + self.m0 @ self.v0 @ self.m0.T, "ppT": self.v0, "pxT": self.v0 @ self.m0.T}

    def post(self, nat):
        m = np.swapaxes(np.linalg.solve(nat["ppT"], nat["pxT"]), -1, -2)
        b = nat["xxT"] - m @ nat["ppT"] @ np.swapaxes(m, -1, -2)
        return {"nu": nat["nu"], "V": nat["ppT"], "M": m, "B": 0.5 * (b + np.swapaxes(b, -1, -2))}

    def eta(self, p):
        w = p["nu"][:, None, None] * np.linalg.inv(p["B"])
        wm = w @ p["M"]
        return {"nu": 0.5 * self.elogdet(p), "xxT": -0.5 * w, "pxT": np.swapaxes(wm, -1, -2), "ppT": -0.5 * (np.swapaxes(p["M"], -1, -2) @ wm + self.dim * np.linalg.inv(p["V"]))}

    def cumulant(self, p):
        return self.wishart_cumulant(p) + self.dim / 2 * np.linalg.slogdet(p["V"])[1]

    def score(self, batch, p):
        x, prev = batch["x"], batch["xprev"]
        flat = 0.5 * self.elogdet(p) - 0.5 * self.dim * LOG_2PI
        return np.stack([f - 0.5 * nu * self.quad(x - prev @ m.T, b) - 0.5 * self.dim * self.quad(prev, v) for f, nu, m, b, v in zip(flat, p["nu"], p["M"], p["B"], p["V"])], axis=1)

    def em(self, s):
        ridge = self.min_covar * np.eye(self.v0.shape[0])
        a = np.swapaxes(np.linalg.solve(s["ppT"] + ridge, s["pxT"]), -1, -2)
        cov = (s["xxT"] - a @ s["pxT"]) / np.maximum(s["N"], 1e-300)[:, None, None]
        return {"A": a, "cov": 0.5 * (cov + np.swapaxes(cov, -1, -2)) + self.min_covar * np.eye(self.dim)}

    def em_score(self, batch, p):
        return np.stack([-0.5 * (self.dim * LOG_2PI + np.linalg.slogdet(c)[1] + self.quad(batch["x"] - batch["xprev"] @ a.T, c)) for a, c in zip(p["A"], p["cov"])], axis=1)


class GaussRegress(Likelihood):
    """Linear regression of y on x with a trailing 1, Normal-Gamma; batches have ``x`` and ``y``. VB only."""

    name = "GaussRegressYFromFixedX"

    def __init__(self, dim: int, *, nu: float = 1e-6, tau: float = 1e-6, prec: float = 1e-6, w=0.0):
        self.e = dim + 1
        self.nu0, self.tau0, self.p0 = nu, tau, np.eye(self.e) * prec
        self.w0 = np.broadcast_to(np.asarray(w, float), (self.e,))

    def scale(self, n):
        return n

    @staticmethod
    def wide(x):
        return np.column_stack([x, np.ones(len(x))])

    def stats(self, batch, resp):
        x, y = self.wide(batch["x"]), batch["y"]
        return {"N": resp.sum(0), "xxT": _outer_sum(resp, x, x), "yx": (resp * y[:, None]).T @ x, "yy": resp.T @ (y * y)}

    def increments(self, s):
        return {"nu": s["N"], "P": s["xxT"], "Pw": s["yx"], "tt": s["yy"]}

    def prior(self):
        return {"nu": np.asarray(self.nu0), "P": self.p0, "Pw": self.p0 @ self.w0, "tt": np.asarray(self.tau0 + self.w0 @ self.p0 @ self.w0)}

    def post(self, nat):
        w = np.linalg.solve(nat["P"], nat["Pw"][..., None])[..., 0]
        return {"nu": nat["nu"], "P": nat["P"], "w": w, "tau": np.maximum(nat["tt"] - (w * nat["Pw"]).sum(-1), 1e-300)}

    def eta(self, p):
        d = p["nu"] / p["tau"]
        elog = digamma(p["nu"] / 2) - np.log(p["tau"] / 2)
        ww = p["w"][:, :, None] * p["w"][:, None, :]
        return {"nu": 0.5 * elog, "P": -0.5 * (d[:, None, None] * ww + np.linalg.inv(p["P"])), "Pw": d[:, None] * p["w"], "tt": -0.5 * d}

    def cumulant(self, p):
        return -gammaln(p["nu"] / 2) - p["nu"] / 2 * math.log(2) + p["nu"] / 2 * np.log(p["tau"]) + 0.5 * np.linalg.slogdet(p["P"])[1]

    def base(self, s):
        return -0.5 * LOG_2PI * float(s["N"].sum())

    def score(self, batch, p):
        x, y = self.wide(batch["x"]), batch["y"]
        elog = digamma(p["nu"] / 2) - np.log(p["tau"] / 2)
        out = [-0.5 * LOG_2PI + 0.5 * e - 0.5 * (nu / t * (y - x @ w) ** 2 + np.einsum("ni,ij,nj->n", x, np.linalg.inv(pp), x)) for e, nu, t, w, pp in zip(elog, p["nu"], p["tau"], p["w"], p["P"])]
        return np.stack(out, axis=1)

    def predict(self, batch, p):
        """y predicted by every component: N x K."""
        return self.wide(batch["x"]) @ p["w"].T


class Joint(Likelihood):
    """Two likelihoods of the same rows, e.g. DiagGauss over x and regression of y on x."""

    def __init__(self, **parts: Likelihood):
        self.parts = parts
        self.name = "+".join(p.name for p in parts.values())

    def scale(self, n):
        return sum(p.scale(n) for p in self.parts.values())

    def _of(self, name, d):
        return {k.split(".", 1)[1]: v for k, v in d.items() if k.startswith(name + ".")}

    def _all(self, f):
        return {f"{n}.{k}": v for n, p in self.parts.items() for k, v in f(n, p).items()}

    def stats(self, batch, resp):
        return {"N": resp.sum(0)} | self._all(lambda n, p: p.stats(batch, resp))

    def nat(self, s):
        return self._all(lambda n, p: p.nat(self._of(n, s)))

    def increments(self, s):
        return self._all(lambda n, p: p.increments(self._of(n, s)))

    def prior(self):
        return self._all(lambda n, p: p.prior())

    def post(self, nat):
        return self._all(lambda n, p: p.post(self._of(n, nat)))

    def eta(self, post):
        return self._all(lambda n, p: p.eta(self._of(n, post)))

    def cumulant(self, post):
        return sum(p.cumulant(self._of(n, post)) for n, p in self.parts.items())

    def base(self, s):
        return sum(p.base(self._of(n, s)) for n, p in self.parts.items())

    def score(self, batch, post):
        return sum(p.score(batch, self._of(n, post)) for n, p in self.parts.items())


class Mult(Likelihood):
    """Dirichlet-multinomial over a vocabulary; rows of ``x`` are count vectors."""

    name = "Mult"

    def __init__(self, vocab: int, *, lam: float = 0.1, min_phi: float = 1e-100):
        self.vocab, self.lam0, self.min_phi = vocab, np.broadcast_to(np.asarray(lam, float), (vocab,)), min_phi

    def scale(self, n):
        return n

    def stats(self, batch, resp):
        return {"N": resp.sum(0), "WordCounts": resp.T @ batch["x"]}

    def increments(self, s):
        return {"lam": s["WordCounts"]}

    def prior(self):
        return {"lam": self.lam0}

    def post(self, nat):
        return {"lam": nat["lam"]}

    def eta(self, p):
        return {"lam": digamma(p["lam"]) - digamma(p["lam"].sum(1))[:, None]}

    def cumulant(self, p):
        return gammaln(p["lam"].sum(1)) - gammaln(p["lam"]).sum(1)

    def score(self, batch, p):
        return batch["x"] @ self.eta(p)["lam"].T

    def em(self, s):
        phi = np.maximum(s["WordCounts"] / np.maximum(s["WordCounts"].sum(1, keepdims=True), 1e-300), self.min_phi)
        return {"phi": phi}

    def em_score(self, batch, p):
        return batch["x"] @ np.log(p["phi"]).T

    def divergence(self, batch, stats):
        phi = (stats["WordCounts"] + self.lam0) / (stats["WordCounts"] + self.lam0).sum(1, keepdims=True)
        x = batch["x"]
        own = x / np.maximum(x.sum(1, keepdims=True), 1e-300)
        flat = (x * np.log(np.where(own > 0, own, 1.0))).sum(1)
        return np.maximum(flat[:, None] - x @ np.log(phi).T, 0)


class Bern(Likelihood):
    """Beta-Bernoulli; rows of ``x`` are 0/1 vectors."""

    name = "Bern"

    def __init__(self, dim: int, *, lam1: float = 0.1, lam0: float = 0.1, eps: float = 1e-8):
        self.dim, self.eps = dim, eps
        self.a, self.b = (np.broadcast_to(np.asarray(v, float), (dim,)) for v in (lam1, lam0))

    def scale(self, n):
        return n * self.dim

    def stats(self, batch, resp):
        x = batch["x"]
        return {"N": resp.sum(0), "Count1": resp.T @ x, "Count0": resp.T @ (1 - x)}

    def increments(self, s):
        return {"lam1": s["Count1"], "lam0": s["Count0"]}

    def prior(self):
        return {"lam1": self.a, "lam0": self.b}

    def post(self, nat):
        return dict(nat)

    def eta(self, p):
        both = digamma(p["lam1"] + p["lam0"])
        return {"lam1": digamma(p["lam1"]) - both, "lam0": digamma(p["lam0"]) - both}

    def cumulant(self, p):
        return (gammaln(p["lam1"] + p["lam0"]) - gammaln(p["lam1"]) - gammaln(p["lam0"])).sum(1)

    def score(self, batch, p):
        e = self.eta(p)
        return batch["x"] @ (e["lam1"] - e["lam0"]).T + e["lam0"].sum(1)

    def em(self, s):
        return {"phi": np.clip(s["Count1"] / np.maximum(s["Count1"] + s["Count0"], 1e-300), self.eps, 1 - self.eps)}

    def em_score(self, batch, p):
        return batch["x"] @ (np.log(p["phi"]) - np.log1p(-p["phi"])).T + np.log1p(-p["phi"]).sum(1)

    def divergence(self, batch, stats):
        phi = (stats["Count1"] + self.a) / (stats["Count1"] + stats["Count0"] + self.a + self.b)
        return -self.em_score(batch, {"phi": phi})
