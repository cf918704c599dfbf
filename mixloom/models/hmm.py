"""Hidden Markov models, finite and hierarchical Dirichlet process, over whole sequences.

A sequence is one row (seq_id, n INT, x ARRAY<DOUBLE> row-major, xprev likewise if the
likelihood needs it): the recurrence needs its order, so a sequence is one unit of work.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixloom.functions.numeric import stick_to_weights
from mixloom.functions.optimize import best_sticks, first_sticks, sticks_objective
from mixloom.functions.special import digamma, gammaln
from mixloom.models.likelihoods import Likelihood
from mixloom.plans.distributed import summed
from mixloom.plans.fit import FitResult, batch_order, learning_rate


def sequences_as_rows(df: DataFrame, group: str, order: list[str], x: str, *, history: bool = False) -> DataFrame:
    """(seq_id, n, x[, xprev]) from one row per step with an array column; with ``history`` the
    first step of each sequence is only history."""
    steps = F.array_sort(F.collect_list(F.struct(*order, F.col(x).cast("array<double>").alias("_x"))))
    rows = df.groupBy(F.col(group).alias("seq_id")).agg(steps.alias("_s")).withColumn("_xs", F.transform("_s", lambda e: e["_x"]))
    if not history:
        return rows.select("seq_id", F.size("_xs").alias("n"), F.flatten("_xs").alias("x"))
    n = F.size("_xs") - 1
    return rows.where(F.size("_xs") > 1).select("seq_id", n.alias("n"), F.flatten(F.slice("_xs", F.lit(2), n)).alias("x"), F.flatten(F.slice("_xs", F.lit(1), n)).alias("xprev"))


def forward_backward(log_start: np.ndarray, log_trans: np.ndarray, scores: np.ndarray):
    """(resp T x K, pair sums K x K, pair entropy K x K, first entropy K, log evidence). The start weights
    count for the first row; weights need not be normalised."""
    t, k = scores.shape
    top = scores.max(1, keepdims=True)
    lik, trans = np.exp(scores - top), np.exp(log_trans)
    fwd, norm = np.empty((t, k)), np.empty(t)
    a = np.exp(log_start) * lik[0]
    for i in range(t):
        if i:
            a = (fwd[i - 1] @ trans) * lik[i]
        norm[i] = a.sum() + 1e-300
        fwd[i] = a / norm[i]
    back = np.ones((t, k))
    for i in range(t - 2, -1, -1):
        back[i] = (trans @ (lik[i + 1] * back[i + 1])) / norm[i + 1]
    resp = fwd * back
    resp /= resp.sum(1, keepdims=True)
    pairs, entropy = np.zeros((k, k)), np.zeros((k, k))
    if t > 1:
        right = lik[1:] * back[1:] / norm[1:, None]
        pairs = trans * (fwd[:-1].T @ right)
        for lo in range(0, t - 1, 4096):  # blocks bound the memory of long sequences
            each = fwd[:-1][lo : lo + 4096, :, None] * trans * right[lo : lo + 4096, None, :]
            given = each / (each.sum(2, keepdims=True) + 1e-300)
            entropy -= (each * np.log(np.where(given > 1e-300, given, 1.0))).sum(0)
    first = -resp[0] * np.log(np.where(resp[0] > 1e-300, resp[0], 1.0))
    return resp, pairs, entropy, first, float(np.log(norm).sum() + top.sum())


def viterbi(log_start: np.ndarray, log_trans: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """The most probable state path; the lowest state on ties."""
    t, k = scores.shape
    best, back = log_start + scores[0], np.zeros((t, k), int)
    for i in range(1, t):
        every = best[:, None] + log_trans
        back[i] = every.argmax(0)
        best = every.max(0) + scores[i]
    path = np.empty(t, int)
    path[-1] = best.argmax()
    for i in range(t - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


class HMM:
    """``hdp=False``: symmetric Dirichlet rows. ``hdp=True``: rows share stick weights. ``kappa`` is
    added to self-transitions."""

    def __init__(self, obs: Likelihood, *, hdp: bool = False, start_alpha: float | None = None, trans_alpha: float | None = None, kappa: float = 0.0, gamma: float = 10.0):
        self.obs, self.hdp, self.kappa, self.gamma = obs, hdp, kappa, gamma
        self.start_alpha = start_alpha if start_alpha is not None else (5.0 if hdp else 1.0)
        self.trans_alpha = trans_alpha if trans_alpha is not None else (0.5 if hdp else 0.1)
        self.name = ("HDPHMM" if hdp else "FiniteHMM") + f" x {obs.name}"

    def priors(self, k: int, rho=None):
        """(start, transition) Dirichlet parameters; the HDP has one more column for the rest."""
        if self.hdp:
            beta = stick_to_weights(rho)
            start, trans = self.start_alpha * beta, np.tile(self.trans_alpha * beta, (k, 1))
        else:
            start, trans = np.full(k, self.start_alpha / k), np.full((k, k), self.trans_alpha / k)
        trans[:, :k] += self.kappa * np.eye(k)
        return start, trans

    def global_step(self, stats, params=None, rounds: int = 2):
        k = len(stats["N"])
        out = {"obs": self.obs.nat(stats)}
        wide = lambda a: np.concatenate([a, np.zeros((*a.shape[:-1], 1))], -1) if self.hdp else a
        rho = omega = None
        if self.hdp:
            rho, omega = first_sticks(k, k + 1.0, self.gamma)
            rho = params["rho"] if params is not None and len(params.get("rho", ())) == k else rho
        for _ in range(rounds if self.hdp else 1):
            ps, pt = self.priors(k, rho)
            start, trans = ps + wide(stats["start"]), pt + wide(stats["trans"])
            if self.hdp:
                es, et = self._elog(start), self._elog(trans)
                rho = best_sticks(rho, omega, n_rows=k + 1.0, gamma=self.gamma, pull=self.start_alpha * es + self.trans_alpha * et.sum(0))
        if self.hdp:
            ps, pt = self.priors(k, rho)
            start, trans = ps + wide(stats["start"]), pt + wide(stats["trans"])
            out |= {"rho": rho, "omega": omega}
        return out | {"start": start, "trans": trans}

    @staticmethod
    def _elog(theta):
        return digamma(theta) - digamma(theta.sum(-1, keepdims=True))

    def log_weights(self, params):
        k = len(params["trans"])
        return self._elog(params["start"])[:k], self._elog(params["trans"])[:, :k]

    def objective(self, stats, params):
        """Lower bound; exact for posteriors that belong to ``stats``, with slack otherwise."""
        k = len(stats["N"])
        c = lambda a: gammaln(a.sum(-1)) - gammaln(a).sum(-1)
        ps, pt = self.priors(k, params.get("rho"))
        wide = lambda a: np.concatenate([a, np.zeros((*a.shape[:-1], 1))], -1) if self.hdp else a
        slack = ((ps + wide(stats["start"]) - params["start"]) * self._elog(params["start"])).sum() + ((pt + wide(stats["trans"]) - params["trans"]) * self._elog(params["trans"])).sum()
        total = self.obs.objective(stats, params["obs"]) + float(stats["h_start"].sum() + stats["h_trans"].sum()) + float(slack)
        total -= float(c(params["start"]) + c(params["trans"]).sum())
        if not self.hdp:
            return total + float(c(ps) + c(pt).sum())
        top, _ = sticks_objective(params["rho"], params["omega"], n_rows=k + 1.0, gamma=self.gamma, pull=np.zeros(k + 1))
        return total + top + k * (np.log(self.start_alpha) + k * np.log(self.trans_alpha))

    def lap(self, seqs: DataFrame, params: dict) -> dict | None:
        log_start, log_trans = self.log_weights(params)
        post, obs = self.obs.post(params["obs"]), self.obs
        cols = [c for c in ("x", "xprev") if c in seqs.columns]

        def step(records):
            for r in records:
                values = [r.column(c).to_pylist() for c in cols]
                for n, *arrays in zip(r.column("n").to_pylist(), *values):
                    if not n:
                        continue
                    batch = {c: np.asarray(a, float).reshape(n, -1) for c, a in zip(cols, arrays)}
                    resp, pairs, h, first, ev = forward_backward(log_start, log_trans, obs.score(batch, post))
                    yield obs.stats(batch, resp) | {"start": resp[0], "trans": pairs, "h_start": first, "h_trans": h, "evidence": np.array([ev]), "n": np.array([float(n)])}

        return summed(seqs.select("n", *cols), step)

    def first_stats(self, seqs: DataFrame, k: int, seed: int) -> dict:
        """Even stretches of random sequences as first states."""
        cols = [c for c in ("x", "xprev") if c in seqs.columns]
        h = F.md5(F.concat_ws("|", F.col("seq_id").cast("string"), F.lit(str(seed))))
        rows = seqs.where("n > 0").orderBy(h, "seq_id").limit(k).collect()
        batch = {c: np.concatenate([np.asarray(r[c], float).reshape(r["n"], -1) for r in rows]) for c in cols}
        n = len(next(iter(batch.values())))
        z = np.minimum(np.arange(n) * k // max(1, n), k - 1)
        return self.obs.stats(batch, np.eye(k)[z]) | {"start": np.ones(k) / k, "trans": np.ones((k, k)) / k}


def fit_hmm(seqs: DataFrame, model: HMM, k: int, *, alg: str = "vb", laps: int = 6, n_batches: int = 4, seed: int = 0, tol: float = 0.05) -> FitResult:
    """VB, memoized VB over ``batch_id``, or stochastic VB."""
    first = model.first_stats(seqs, k, seed)
    params, result, blocks, before, step = model.global_step(first), FitResult({}, {}, uids=list(range(k))), {}, None, 0
    sizes = {r["batch_id"]: r["n"] for r in seqs.groupBy("batch_id").agg(F.sum("n").alias("n")).collect()} if alg == "sovb" else {}
    for lap in range(1, laps + 1):
        for done, b in enumerate([None] if alg == "vb" else batch_order(n_batches, lap, seed), 1):
            part = model.lap(seqs if b is None else seqs.where(F.col("batch_id") == int(b)), params)
            if part is None:
                continue
            if alg == "sovb":
                factor = sum(sizes.values()) / sizes[int(b)]
                stats = {n: v * factor for n, v in part.items()}
                new, rate = model.global_step(stats, params), learning_rate(step)
                mix = lambda old, x: {n: mix(old[n], v) for n, v in x.items()} if isinstance(x, dict) else (1 - rate) * old + rate * x  # noqa: E731, B023
                params = mix(params, new)
                step += 1
            else:
                blocks[-1 if b is None else int(b)] = part
                stats = {n: sum(x[n] for x in blocks.values()) for n in part}
                params = model.global_step(stats, params)
            if alg != "memovb" or len(blocks) == n_batches or done == n_batches:
                result.trace.append({"lap": lap - 1 + done / (1 if b is None else n_batches), "loss": float(-model.objective(stats, params) / model.obs.scale(float(stats["n"][0]))), "k": k})
        if before is not None and alg != "sovb" and np.abs(stats["N"] - before).max() < tol:
            result.converged = True
            break
        before = stats["N"]
    result.params, result.stats = params, stats
    return result


def _per_sequence(seqs: DataFrame, score, columns: str, of) -> DataFrame:
    """(seq_id, pos, ...) from ``of(scores)``, which gives one array per further column."""
    cols = [c for c in ("x", "xprev") if c in seqs.columns]

    def step(records):
        import pyarrow as pa

        for r in records:
            values = [r.column(c).to_pylist() for c in cols]
            for seq, n, *arrays in zip(r.column("seq_id").to_pylist(), r.column("n").to_pylist(), *values):
                if n:
                    found = of(score({c: np.asarray(a, float).reshape(n, -1) for c, a in zip(cols, arrays)}))
                    yield pa.RecordBatch.from_pydict({"seq_id": pa.array([seq] * n, pa.int64()), "pos": pa.array(range(n), pa.int32())} | {k: pa.array(list(v)) for k, v in found.items()})

    return seqs.select(F.col("seq_id").cast("bigint"), "n", *cols).mapInArrow(step, f"seq_id bigint, pos int, {columns}")


def paths(seqs: DataFrame, log_start: np.ndarray, log_trans: np.ndarray, score) -> DataFrame:
    """(seq_id, pos, state): the most probable path of each sequence; ``score`` gives the log likelihoods of a batch."""
    return _per_sequence(seqs, score, "state int", lambda s: {"state": viterbi(log_start, log_trans, s).astype(np.int32)})


def posteriors(seqs: DataFrame, log_start: np.ndarray, log_trans: np.ndarray, score) -> DataFrame:
    """(seq_id, pos, resp ARRAY): the probability of each state at each step."""
    return _per_sequence(seqs, score, "resp array<double>", lambda s: {"resp": forward_backward(log_start, log_trans, s)[0]})


def decode(seqs: DataFrame, model: HMM, params: dict) -> DataFrame:
    """(seq_id, pos, state): the most probable path of each sequence."""
    post, obs = model.obs.post(params["obs"]), model.obs
    return paths(seqs, *model.log_weights(params), lambda batch: obs.score(batch, post))
