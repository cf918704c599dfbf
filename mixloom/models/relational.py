"""Stochastic block models over edges: single and mixed membership, assortative, and HDP forms.

Node factors live in a DataFrame (node, elog ARRAY<DOUBLE>) and reach edges by two equi-joins;
edges send their mass back as grouped sums. Only K x K statistics come to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixloom.functions.numeric import stick_to_weights
from mixloom.functions.optimize import best_sticks, first_sticks, sticks_objective
from mixloom.functions.special import digamma, gammaln
from mixloom.plans.distributed import pack, unpack
from mixloom.session import cut


class BlockModel:
    """Mixed-membership block model of 0/1 edges (src, dst, x).

    ``assortative``: an edge within one community has that community's rate; between
    communities it has rate ``epsilon``. ``single``: nodes have one community each, and both
    ends of their edges share it. ``hdp``: node weights alpha * E[beta] from sticks.
    """

    def __init__(self, *, alpha: float = 0.5, lam1: float = 0.1, lam0: float = 0.1, assortative: bool = False, single: bool = False, hdp: bool = False, epsilon: float = 0.05, gamma: float = 10.0):
        self.alpha, self.lam1, self.lam0, self.epsilon = alpha, lam1, lam0, epsilon
        self.assortative, self.single, self.hdp, self.gamma = assortative, single, hdp, gamma
        kind = "SMSB" if single else "MMSB"
        self.name = ("HDP" if hdp else "Finite") + ("Assortative" if assortative else "") + kind + " x Bern"

    def prior(self, k: int, rho=None) -> np.ndarray:
        return self.alpha * stick_to_weights(rho)[:k] if self.hdp else np.full(k, self.alpha / k)

    def rest(self, rho) -> float:
        return self.alpha * stick_to_weights(rho)[-1] if self.hdp else 0.0

    def edge_scores(self, lam1, lam0, k):
        """E[log p(x)] per pair of communities for x = 1 and x = 0: two K x K tables."""
        both = digamma(lam1 + lam0)
        e1, e0 = digamma(lam1) - both, digamma(lam0) - both
        if not self.assortative:
            return e1, e0
        t1, t0 = np.full((k, k), np.log(self.epsilon)), np.full((k, k), np.log(1 - self.epsilon))
        np.fill_diagonal(t1, e1)
        np.fill_diagonal(t0, e0)
        return t1, t0

    def beta_bound(self, lam1, lam0, s1, s0):
        c = lambda a, b: gammaln(a + b) - gammaln(a) - gammaln(b)
        both = digamma(lam1 + lam0)
        e1, e0 = digamma(lam1) - both, digamma(lam0) - both
        slack = (s1 + self.lam1 - lam1) * e1 + (s0 + self.lam0 - lam0) * e0
        return float((c(self.lam1, self.lam0) - c(lam1, lam0) + slack).sum())


def _edge_step(model: BlockModel, t1, t0, k: int):
    """For mapInArrow: edges with both ends' factors to node masses and one block of sums."""

    def run(records):
        for r in records:
            if not r.num_rows:
                continue
            x = r.column("x").to_numpy(zero_copy_only=False).astype(float)
            ends = [r.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, k) for c in ("elog_src", "elog_dst")]
            s = x[:, None, None] * t1 + (1 - x)[:, None, None] * t0 + ends[0][:, :, None] + ends[1][:, None, :]
            flat = s.reshape(len(x), -1)
            top = flat.max(1, keepdims=True)
            resp = np.exp(flat - top)
            norm = resp.sum(1, keepdims=True)
            evidence = float((np.log(norm) + top).sum())
            resp = np.maximum(resp / norm, 1e-100).reshape(len(x), k, k)
            sums = {"s1": (resp * x[:, None, None]).sum(0), "s0": (resp * (1 - x)[:, None, None]).sum(0), "h": np.array([-(resp * np.log(resp)).sum()]), "evidence": np.array([evidence]), "n": np.array([float(len(x))])}
            ids = np.concatenate([r.column("src").to_numpy(zero_copy_only=False), r.column("dst").to_numpy(zero_copy_only=False)])
            mass = np.concatenate([resp.sum(2), resp.sum(1)])
            nodes, place = np.unique(ids, return_inverse=True)
            total = np.zeros((len(nodes), k))
            np.add.at(total, place, mass)
            cols = {"node": pa.array([*nodes.tolist(), None], pa.int64()), "payload": pa.array([None] * len(nodes) + [pack(sums)], pa.binary())}
            cols |= {f"m{i}": pa.array([*total[:, i], 0.0]) for i in range(k)}
            yield pa.RecordBatch.from_pydict(cols)

    return run


def _added(blocks: DataFrame, shapes: dict) -> list:
    """Sums of the blocks in 32 groups, so that the driver gets few of them."""
    import pandas as pd

    def add(key, pdf):
        total = sum(np.frombuffer(p, np.float64) for p in pdf["payload"])
        return pd.DataFrame({"payload": [np.asarray(total).tobytes()]})

    grouped = blocks.withColumn("_g", F.spark_partition_id() % 32).groupBy("_g").applyInPandas(add, "payload binary")
    return grouped.collect()


#: Node factors up to this many bytes are broadcast to the edges; larger ones are joined by shuffles.
BROADCAST_BYTES = 32 << 20


def _at_ends(edges: DataFrame, nodes: DataFrame, value: str, prefix: str, n_nodes: int, k: int) -> DataFrame:
    """Edges with ``value`` of both ends as ``prefix``_src and ``prefix``_dst."""
    for end in ("src", "dst"):
        one = nodes.select(F.col("node").alias(end), F.col(value).alias(f"{prefix}_{end}"))
        edges = edges.join(F.broadcast(one) if n_nodes * (8 * k + 32) <= BROADCAST_BYTES else one, end)
    return edges


def _per_batch(f, kind: str):
    """A pandas UDF of ``f`` over the rows of an array column, stacked to a matrix."""
    import pandas as pd

    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(f(np.vstack(s.to_numpy())))) if len(s) else s

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)


def fit_single_blocks(edges: DataFrame, model: BlockModel, k: int, *, laps: int = 8, seed: int = 0, tol: float = 1e-5) -> tuple[DataFrame, dict, list[float]]:
    """(nodes (node, resp), parameters, losses) of the single-membership block model.

    All nodes move at once along the natural gradient; a step that lowers the bound is halved
    and tried again, so the loss never rises.
    """
    edges = edges.select("src", "dst", F.col("x").cast("double").alias("x"))
    ids = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    h = F.md5(F.concat_ws("|", F.col("node").cast("string"), F.lit(str(seed))))
    first = (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % k).cast("int")
    nodes = cut(ids.select("node", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(i == first, 0.6).otherwise(0.4 / max(1, k - 1))).alias("resp")))
    n_edges, n_nodes = edges.count(), nodes.count()
    schema = "node bigint, payload binary, " + ", ".join(f"m{i} double" for i in range(k))

    def state(now, tables):
        """Bound pieces under ``now`` and, given score tables, each node's message."""
        def run(records):
            for r in records:
                if not r.num_rows:
                    continue
                x = r.column("x").to_numpy(zero_copy_only=False).astype(float)
                p, q = (r.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, k) for c in ("r_src", "r_dst"))
                cols = {"node": [None], "payload": [pack({"s1": (p * x[:, None]).T @ q, "s0": (p * (1 - x)[:, None]).T @ q})]}
                total = np.zeros((1, k))
                if tables is not None:
                    t = x[:, None, None] * tables[0] + (1 - x)[:, None, None] * tables[1]
                    mass = np.concatenate([np.einsum("nkl,nl->nk", t, q), np.einsum("nkl,nk->nl", t, p)])
                    every = np.concatenate([r.column("src").to_numpy(zero_copy_only=False), r.column("dst").to_numpy(zero_copy_only=False)])
                    own, place = np.unique(every, return_inverse=True)
                    sums = np.zeros((len(own), k))
                    np.add.at(sums, place, mass)
                    cols = {"node": [None, *own.tolist()], "payload": cols["payload"] + [None] * len(own)}
                    total = np.concatenate([total, sums])
                yield pa.RecordBatch.from_pydict({"node": pa.array(cols["node"], pa.int64()), "payload": pa.array(cols["payload"], pa.binary())} | {f"m{i}": pa.array(total[:, i]) for i in range(k)})

        out = cut(_at_ends(edges, now, "resp", "r", n_nodes, k).mapInArrow(run, schema))
        shapes = {"s1": (k, k), "s0": (k, k)}
        parts = [unpack(bytes(r["payload"]), shapes) for r in _added(out.where("node IS NULL").select("payload"), shapes)]
        s1, s0 = sum(p["s1"] for p in parts), sum(p["s0"] for p in parts)
        row = now.select(F.transform("resp", lambda v: F.when(v > 0, -v * F.ln(v)).otherwise(0.0)).alias("h"), "resp").agg(F.sum(F.aggregate("h", F.lit(0.0), lambda s, v: s + v)), *[F.sum(F.get("resp", F.lit(i))) for i in range(k)]).first()
        n, prior = np.array(row[1:], float), np.full(k, model.alpha / k)
        c = lambda t: float(gammaln(t.sum()) - gammaln(t).sum())
        bound = float(row[0]) + c(prior) - c(prior + n) + model.beta_bound(s1 + model.lam1, s0 + model.lam0, s1, s0)
        return bound, s1, s0, n, out

    bound, s1, s0, n, _ = state(nodes, None)
    losses = [-bound / n_edges]
    softmax = _per_batch(lambda v: (e := np.exp(v - v.max(1, keepdims=True))) / e.sum(1, keepdims=True), "array<double>")
    for _ in range(laps):
        tables = model.edge_scores(s1 + model.lam1, s0 + model.lam0, k)
        theta = n + model.alpha / k
        log_pi = digamma(theta) - digamma(theta.sum())
        *_, out = state(nodes, tables)
        message = out.where("node IS NOT NULL").groupBy("node").agg(F.array(*[F.sum(f"m{i}") + float(log_pi[i]) for i in range(k)]).alias("target"))
        both, step, moved = cut(nodes.join(message, "node")), 1.0, False
        while step > 1e-3:
            trial = cut(both.select("node", softmax(F.zip_with("resp", "target", _blend(step))).alias("resp")))
            new = state(trial, None)
            if new[0] >= bound:
                moved = new[0] - bound > tol * n_edges
                nodes, (bound, s1, s0, n, _) = trial, new
                break
            step /= 2
        losses.append(-bound / n_edges)
        if not moved:
            break
    return nodes, {"lam1": s1 + model.lam1, "lam0": s0 + model.lam0, "n": n}, losses


def _blend(step: float):
    def f(old, target):
        return F.ln(F.greatest(old, F.lit(1e-100))) * (1 - step) + target * step

    return f


def fit_blocks(edges: DataFrame, model: BlockModel, k: int, *, laps: int = 8, seed: int = 0, tol: float = 1e-4) -> tuple[DataFrame, dict, list[float]]:
    """(nodes (node, theta), parameters, losses) by variational Bayes.

    A lap: join node factors to both ends of every edge, score all K x K pairs, add masses per
    node and K x K sums. Starts from hash-drawn node weights, the same on any partitioning.
    """
    if model.single:
        return fit_single_blocks(edges, model, k, laps=laps, seed=seed, tol=tol)
    edges = edges.select("src", "dst", F.col("x").cast("double").alias("x"))
    ids = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    n_nodes = ids.count()
    rho, omega = first_sticks(k, float(n_nodes), model.gamma) if model.hdp else (None, None)
    u = [(F.conv(F.substring(F.md5(F.concat_ws("|", F.col("node").cast("string"), F.lit(f"{seed}.{i}"))), 1, 8), 16, 10).cast("double") + 1) / 2.0**32 for i in range(k)]
    nodes = cut(ids.select("node", F.array(*[F.lit(float(p)) + v * 2.0 for p, v in zip(model.prior(k, rho), u)]).alias("theta")))
    shape = (k,) if model.assortative else (k, k)
    lam1, lam0 = np.full(shape, 1.0), np.full(shape, 1.0)
    if model.assortative:
        lam1 = lam1 + 1
    else:
        lam1, lam0 = lam1 + np.eye(k), lam0 + (1 - np.eye(k))
    digamma_udf = _per_batch(lambda t: digamma(t) - digamma(t.sum(1, keepdims=True)), "array<double>")
    losses: list[float] = []
    for lap in range(laps):
        rest = model.rest(rho)
        theta_all = F.concat("theta", F.array(F.lit(float(rest)))) if model.hdp else F.col("theta")
        factors = nodes.select("node", F.slice(digamma_udf(theta_all), 1, k).alias("elog"))
        t1, t0 = model.edge_scores(lam1, lam0, k)
        schema = "node bigint, payload binary, " + ", ".join(f"m{i} double" for i in range(k))
        out = cut(_at_ends(edges, factors, "elog", "elog", n_nodes, k).mapInArrow(_edge_step(model, t1, t0, k), schema))
        shapes = {"s1": (k, k), "s0": (k, k), "h": (1,), "evidence": (1,), "n": (1,)}
        total = None
        for r in _added(out.where("node IS NULL").select("payload"), shapes):
            part = unpack(bytes(r["payload"]), shapes)
            total = part if total is None else {n: total[n] + v for n, v in part.items()}
        s1, s0 = (np.diag(total["s1"]), np.diag(total["s0"])) if model.assortative else (total["s1"], total["s0"])
        lam1, lam0 = s1 + model.lam1, s0 + model.lam0
        prior = model.prior(k, rho)
        mass = out.where("node IS NOT NULL").groupBy("node").agg(F.array(*[F.sum(f"m{i}") + float(prior[i]) for i in range(k)]).alias("theta"))
        nodes = cut(mass)
        # bound at the updated node factors and block rates
        rest = model.rest(rho)

        def bound(t, rest=rest):
            t = np.column_stack([t, np.full(len(t), rest)]) if rest else t
            return gammaln(t).sum(1) - gammaln(t.sum(1))

        node_part = nodes.agg(F.sum(_per_batch(bound, "double")("theta"))).first()[0]
        first = np.append(prior, rest) if rest else prior
        loss = node_part + n_nodes * float(gammaln(first.sum()) - gammaln(first).sum()) + model.beta_bound(lam1, lam0, s1, s0) + float(total["h"][0])
        if model.assortative:
            off = ~np.eye(k, dtype=bool)
            loss += float(total["s1"][off].sum() * np.log(model.epsilon) + total["s0"][off].sum() * np.log(1 - model.epsilon))
        if model.hdp:
            loss -= n_nodes * float(gammaln(first.sum()) - gammaln(first).sum())
            top, _ = sticks_objective(rho, omega, n_rows=float(n_nodes), gamma=model.gamma, pull=np.zeros(k + 1))
            loss += top + n_nodes * k * float(np.log(model.alpha))
        losses.append(float(-loss / total["n"][0]))
        if model.hdp:
            full = F.concat("theta", F.array(F.lit(float(rest))))
            sums = nodes.select(digamma_udf(full).alias("e")).agg(*[F.sum(F.get("e", F.lit(i))) for i in range(k + 1)]).first()
            rho = best_sticks(rho, omega, n_rows=float(n_nodes), gamma=model.gamma, pull=model.alpha * np.array(sums, float))
        if lap and abs(losses[-1] - losses[-2]) < tol:
            break
    return nodes, {"lam1": lam1, "lam0": lam0, "rho": rho}, losses
