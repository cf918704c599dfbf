"""Topic models: finite (LDA) and hierarchical Dirichlet process, over documents as sparse rows.

A document is one row (doc_id, ids ARRAY<INT>, counts ARRAY<DOUBLE>), so laps never shuffle
tokens. The local step is a per-document fixed point in numpy; a partition passes on its K x V
word counts and a few sums.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixloom.functions.numeric import stick_to_weights
from mixloom.functions.optimize import best_sticks, first_sticks, sticks_objective
from mixloom.functions.special import digamma, gammaln
from mixloom.models.likelihoods import Mult
from mixloom.plans.distributed import summed
from mixloom.plans.fit import Event, FitResult, batch_order, draw_rows, learning_rate


def documents_as_rows(bag: DataFrame) -> DataFrame:
    """(doc_id, ids, counts) from (doc_id, word_id, word_count), ids ascending."""
    pairs = F.array_sort(F.collect_list(F.struct("word_id", "word_count")))
    rows = bag.groupBy("doc_id").agg(pairs.alias("_p"))
    return rows.select("doc_id", F.col("_p.word_id").cast("array<int>").alias("ids"), F.col("_p.word_count").cast("array<double>").alias("counts"))


def dirichlet_c(theta: np.ndarray) -> np.ndarray:
    return gammaln(theta.sum(-1)) - gammaln(theta).sum(-1)


def doc_step(lik: np.ndarray, counts: np.ndarray, prior: np.ndarray, *, iters: int = 50, tol: float = 0.01, start: np.ndarray | None = None):
    """Topic counts of one document and its responsibilities. ``lik`` is U x K, ``prior`` the K
    Dirichlet parameters; stops when no count moves by ``tol`` (looked at every fifth round)."""
    count = np.zeros(len(prior)) if start is None else start
    prob = prior.copy() if start is None else np.exp(digamma(count + prior))
    for i in range(iters):
        if i:
            prob = np.exp(digamma(count + prior))
        new = prob * ((counts / (lik @ prob + 1e-300)) @ lik)
        done = i % 5 == 0 and np.abs(new - count).max() < tol
        count = new
        if done:
            break
    prob = np.exp(digamma(count + prior))
    resp = lik * prob
    resp /= resp.sum(1, keepdims=True) + 1e-300
    return counts @ resp, resp


def doc_bound(count, resp, lik_log, counts, prior):
    theta = count + prior
    safe = np.where(resp > 1e-300, resp, 1.0)
    h = -(counts @ (resp * np.log(safe)))
    return float(h.sum() + (counts[:, None] * resp * lik_log).sum() - dirichlet_c(theta)), h


def drop_junk(lik, lik_log, counts, prior, count, resp, *, tries: int, iters: int, tol: float):
    """Tries to empty the document's smallest used topics; a try stays if its bound rises."""
    best, _ = doc_bound(count, resp, lik_log, counts, prior)
    for k in np.argsort(count, kind="stable"):
        if tries <= 0:
            break
        if count[k] < 0.01:
            continue
        tries -= 1
        start = count.copy()
        start[k] = 0
        c2, r2 = doc_step(lik, counts, prior, iters=iters, tol=tol, start=start)
        b2, _ = doc_bound(c2, r2, lik_log, counts, prior)
        if b2 > best + 1e-8:
            best, count, resp = b2, c2, r2
    return count, resp


class TopicModel:
    """``hdp=False``: LDA with symmetric alpha / K. ``hdp=True``: weights alpha * E[beta] from sticks."""

    def __init__(self, vocab: int, *, hdp: bool = False, alpha: float = 0.5, gamma: float = 1.0, lam: float = 0.1, iters: int = 50, tol: float = 0.01, restarts: int = 0):
        self.obs, self.hdp, self.alpha, self.gamma = Mult(vocab, lam=lam), hdp, alpha, gamma
        self.iters, self.tol, self.restarts = iters, tol, restarts
        self.name = ("HDPTopic" if hdp else "FiniteTopic") + " x Mult"

    def start(self, word_counts: np.ndarray, n_docs: float) -> dict:
        k = len(word_counts)
        out = {"lam": word_counts + self.obs.lam0}
        if self.hdp:
            out["rho"], out["omega"] = first_sticks(k, n_docs, self.gamma)
        return out

    def prior_of(self, params) -> np.ndarray:
        """Dirichlet parameters of a document: K values, and the rest for the HDP."""
        k = len(params["lam"])
        return self.alpha * stick_to_weights(params["rho"]) if self.hdp else np.full(k, self.alpha / k)

    def local(self, ids, counts, elog, prior, *, iters=None):
        k = elog.shape[0]
        log = elog[:, ids].T
        lik = np.exp(log - log.max(1, keepdims=True))
        count, resp = doc_step(lik, counts, prior[:k], iters=iters or self.iters, tol=self.tol)
        if self.restarts:
            count, resp = drop_junk(lik, log, counts, prior[:k], count, resp, tries=self.restarts, iters=self.iters, tol=self.tol)
        return count, resp

    def lap(self, docs: DataFrame, params: dict) -> dict | None:
        """Statistics of all documents under ``params``."""
        model, prior, elog = self, self.prior_of(params), digamma(params["lam"]) - digamma(params["lam"].sum(1))[:, None]
        k, v = params["lam"].shape

        def step(records):
            out = {n: np.zeros(s) for n, s in (("WordCounts", (k, v)), ("entropy", k), ("sumLogPi", len(prior)), ("docBound", 1), ("nDoc", 1), ("tokens", 1), ("usage", k), ("pairs", (k, k)))}
            for r in records:
                for ids, counts in zip(r.column("ids").to_pylist(), r.column("counts").to_pylist()):
                    if not ids:
                        continue
                    ids, counts = np.asarray(ids), np.asarray(counts, float)
                    count, resp = model.local(ids, counts, elog, prior)
                    out["WordCounts"][:, ids] += (counts[:, None] * resp).T  # a document's ids are distinct
                    safe = np.where(resp > 1e-300, resp, 1.0)
                    out["entropy"] += -(counts @ (resp * np.log(safe)))
                    theta = prior.copy()
                    theta[:k] += count
                    out["sumLogPi"] += digamma(theta) - digamma(theta.sum())
                    out["docBound"] -= dirichlet_c(theta)
                    out["nDoc"] += 1
                    out["tokens"] += counts.sum()
                    out["usage"] += count > 0.01
                    out["pairs"] += np.outer(count, count)
            yield out

        stats = summed(docs.select("ids", "counts"), step)
        if stats is not None:
            stats["N"] = stats["WordCounts"].sum(1)
            stats["priorSeen"] = prior * stats["nDoc"][0]
        return stats

    def global_step(self, stats: dict, params: dict) -> dict:
        out = {"lam": stats["WordCounts"] + self.obs.lam0}
        if self.hdp:
            n = float(stats["nDoc"][0])
            _, omega = first_sticks(len(out["lam"]), n, self.gamma)
            out["omega"] = omega
            out["rho"] = best_sticks(params["rho"], omega, n_rows=n, gamma=self.gamma, pull=self.alpha * stats["sumLogPi"])
        return out

    def objective(self, stats: dict, params: dict) -> float:
        """Lower bound for statistics and the global parameters after (or before) their update."""
        n, k = float(stats["nDoc"][0]), len(stats["WordCounts"])
        obs = {"N": stats["N"], "WordCounts": stats["WordCounts"]}
        total = self.obs.objective(obs, {"lam": params["lam"]}) + float(stats["entropy"].sum()) + float(stats["docBound"][0])
        # documents were fitted with the prior of their lap; the bound is linear in it
        slack = (n * self.prior_of(params) - stats["priorSeen"]) @ (stats["sumLogPi"] / n)
        if not self.hdp:
            return total + n * float(dirichlet_c(self.prior_of(params))) + float(slack)
        top, _ = sticks_objective(params["rho"], params["omega"], n_rows=n, gamma=self.gamma, pull=np.zeros(k + 1))
        return total + top + n * k * np.log(self.alpha) + float(slack)


def topic_correlations(stats: dict) -> np.ndarray:
    """Correlation over documents of the topics' counts, from the sums of a lap; 0 for constant topics."""
    n = float(stats["nDoc"][0])
    mean = stats["N"] / n
    cov = stats["pairs"] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    safe = np.where(np.outer(sd, sd) > 1e-12, np.outer(sd, sd), np.inf)
    return cov / safe


def first_topics(docs: DataFrame, model: TopicModel, k: int, seed: int) -> np.ndarray:
    """Word counts of k random documents, smoothed so that no topic is alone with its words."""
    counts = np.full((k, model.obs.vocab), 1e-3)
    for i, r in enumerate(draw_rows(docs.where(F.size("ids") > 0), "doc_id", k, seed)):
        np.add.at(counts[i], np.asarray(r["ids"]), np.asarray(r["counts"], float))
    return counts + 0.05 * counts.mean(0)


def fit_topics(docs: DataFrame, model: TopicModel, k: int, *, alg: str = "vb", laps: int = 5, n_batches: int = 4, seed: int = 0, tol: float = 0.05, callbacks=()) -> FitResult:
    """``vb``: all documents per lap. ``memovb``: exact totals over fixed batches (``batch_id``).
    ``sovb``: amplified batches with a decaying rate."""
    n_docs = docs.count()
    params, result = model.start(first_topics(docs, model, k, seed), n_docs), FitResult({}, {}, uids=list(range(k)))
    blocks: dict[int, dict] = {}
    add = lambda: {name: sum(b[name] for b in blocks.values()) for name in next(iter(blocks.values()))}
    step, stats, before = 0, None, None
    for lap in range(1, laps + 1):
        for done, b in enumerate([None] if alg == "vb" else batch_order(n_batches, lap, seed), 1):
            part = model.lap(docs if b is None else docs.where(F.col("batch_id") == int(b)), params)
            if part is None or part["nDoc"][0] == 0:
                continue
            if alg == "sovb":
                stats = {n: v * (n_docs / part["nDoc"][0]) for n, v in part.items()}
                new, rate = model.global_step(stats, params), learning_rate(step)
                params = {n: (1 - rate) * params[n] + rate * new[n] for n in new}
                step += 1
            else:
                blocks[-1 if b is None else int(b)] = part
                stats = add()
                params = model.global_step(stats, params)
            if alg != "memovb" or len(blocks) == n_batches or done == n_batches:
                result.trace.append({"lap": lap - 1 + done / (1 if b is None else n_batches), "loss": float(-model.objective(stats, params) / stats["tokens"][0]), "k": k})
                for c in callbacks:
                    c(Event("lap" if b is None else "batch", result.trace[-1]["lap"], result.losses[-1], k, stats, params))
        if before is not None and alg != "sovb" and np.abs(stats["N"] - before).max() < tol:
            result.converged = True
            break
        before = stats["N"]
    result.params, result.stats = params, stats
    return result


class GroupTopicModel(TopicModel):
    """Topics over groups of vectors: any likelihood in place of word probabilities. A group is one row
    (seq_id or doc_id, n, x[, y]) as made by ``sequences_as_rows``; order within it does not matter."""

    def __init__(self, obs, *, hdp: bool = False, alpha: float = 0.5, gamma: float = 1.0, iters: int = 50, tol: float = 0.01):
        self.obs, self.hdp, self.alpha, self.gamma = obs, hdp, alpha, gamma
        self.iters, self.tol, self.restarts = iters, tol, 0
        self.name = ("HDPTopic" if hdp else "FiniteTopic") + f" x {obs.name}"

    def start_from(self, stats: dict, n_docs: float) -> dict:
        k = len(stats["N"])
        out = {"obs": self.obs.nat(stats), "lam": np.zeros((k, 1))}
        if self.hdp:
            out["rho"], out["omega"] = first_sticks(k, n_docs, self.gamma)
        return out

    def lap(self, docs: DataFrame, params: dict) -> dict | None:
        prior, post, obs = self.prior_of(params), self.obs.post(params["obs"]), self.obs
        k, iters, tol = len(params["lam"]), self.iters, self.tol

        def step(records):
            for r in records:
                for n, x in zip(r.column("n").to_pylist(), r.column("x").to_pylist()):
                    if not n:
                        continue
                    batch = {"x": np.asarray(x, float).reshape(n, -1)}
                    log = obs.score(batch, post)
                    lik = np.exp(log - log.max(1, keepdims=True))
                    count, resp = doc_step(lik, np.ones(n), prior[:k], iters=iters, tol=tol)
                    theta = prior.copy()
                    theta[:k] += count
                    yield obs.stats(batch, resp) | {
                        "entropy": -(resp * np.log(np.where(resp > 1e-300, resp, 1.0))).sum(0), "sumLogPi": digamma(theta) - digamma(theta.sum()),
                        "docBound": np.array([-dirichlet_c(theta)]), "nDoc": np.ones(1), "tokens": np.array([float(n)]),
                    }

        stats = summed(docs.select("n", "x"), step)
        if stats is not None:
            stats["priorSeen"] = prior * stats["nDoc"][0]
        return stats

    def global_step(self, stats: dict, params: dict) -> dict:
        word = {"WordCounts": np.zeros((len(stats["N"]), 1)), "nDoc": stats["nDoc"], "sumLogPi": stats["sumLogPi"]}
        saved, self.obs = self.obs, Mult(1)
        try:
            out = super().global_step(word, params)
        finally:
            self.obs = saved
        return out | {"obs": self.obs.nat(stats), "lam": np.zeros((len(stats["N"]), 1))}

    def objective(self, stats: dict, params: dict) -> float:
        n, k = float(stats["nDoc"][0]), len(stats["N"])
        total = self.obs.objective(stats, params["obs"]) + float(stats["entropy"].sum()) + float(stats["docBound"][0])
        slack = (n * self.prior_of(params) - stats["priorSeen"]) @ (stats["sumLogPi"] / n)
        if not self.hdp:
            return total + n * float(dirichlet_c(self.prior_of(params))) + float(slack)
        top, _ = sticks_objective(params["rho"], params["omega"], n_rows=n, gamma=self.gamma, pull=np.zeros(k + 1))
        return total + top + n * k * np.log(self.alpha) + float(slack)


def fit_group_topics(docs: DataFrame, model: GroupTopicModel, k: int, *, laps: int = 5, seed: int = 0) -> FitResult:
    """VB over all groups; starts from even stretches of random groups."""
    from mixloom.models.hmm import HMM

    stats = HMM(model.obs).first_stats(docs, k, seed)
    params, result = model.start_from(stats, docs.count()), FitResult({}, {}, uids=list(range(k)))
    for lap in range(1, laps + 1):
        stats = model.lap(docs, params)
        params = model.global_step(stats, params)
        result.trace.append({"lap": lap, "loss": float(-model.objective(stats, params) / model.obs.scale(float(stats["tokens"][0]))), "k": k})
    result.params, result.stats = params, stats
    return result


def heldout_scores(docs: DataFrame, model: TopicModel, params: dict) -> DataFrame:
    """(doc_id, n_heldout, loglik, auc, r_precision, k_active) per document.

    ``docs`` has ids, counts (seen words) and test_ids, test_counts (held out). Topic proportions
    are fitted to the seen words; loglik is the mean log probability of held-out tokens; AUC and
    R-precision rank the held-out words among all words that were not seen."""
    prior = model.prior_of(params)
    elog = digamma(params["lam"]) - digamma(params["lam"].sum(1))[:, None]
    phi = params["lam"] / params["lam"].sum(1, keepdims=True)
    k = len(phi)

    def step(records):
        import pyarrow as pa

        for r in records:
            rows = []
            for doc, ids, counts, tids, tcounts in zip(*(r.column(c).to_pylist() for c in ("doc_id", "ids", "counts", "test_ids", "test_counts"))):
                if not tids:
                    continue
                theta = prior[:k].copy()
                if ids:
                    theta += model.local(np.asarray(ids), np.asarray(counts, float), elog, prior)[0]
                p = (theta / theta.sum()) @ phi
                tids, tcounts = np.asarray(tids), np.asarray(tcounts, float)
                free = np.ones(len(p), bool)
                free[np.asarray(ids or [], int)] = False
                hit = np.zeros(len(p), bool)
                hit[tids] = True
                hit &= free
                order = np.argsort(p[free], kind="stable")
                y = hit[free][order]
                pos, neg = int(y.sum()), int((~y).sum())
                rank = np.arange(1, len(y) + 1)
                auc = (rank[y].sum() - pos * (pos + 1) / 2) / (pos * neg) if pos and neg else None
                prec = float(y[::-1][:pos].mean()) if pos else None
                rows.append((doc, float(tcounts.sum()), float(tcounts @ np.log(p[tids]) / tcounts.sum()), auc, prec, int((theta / theta.sum() > 0.01).sum())))
            names = ["doc_id", "n_heldout", "loglik", "auc", "r_precision", "k_active"]
            types = [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int32()]
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return docs.select("doc_id", "ids", "counts", "test_ids", "test_counts").mapInArrow(step, "doc_id bigint, n_heldout double, loglik double, auc double, r_precision double, k_active int")


def heldout_callback(docs: DataFrame, model: TopicModel, seen: list[dict], *, every: float = 5, early: float = 0):
    """A callback for ``fit_topics`` that appends held-out means to ``seen`` whenever a checkpoint is due."""
    from mixloom.plans.fit import should_save

    steps = {"n": 0}

    def on(event: Event) -> None:
        if should_save(event.lap, steps["n"], every=every, early=early):
            row = heldout_scores(docs, model, event.params).agg(F.count("*").alias("n_docs"), F.avg("loglik").alias("loglik"), F.avg("auc").alias("auc"), F.avg("r_precision").alias("r_precision")).first()
            seen.append({"lap": event.lap} | row.asDict())
        steps["n"] += 1

    return on
