"""One entry point for fits: names and options to a model, several tasks, the best by loss.

    python -m mixloom.run DATA ALLOC OBS ALG [--option value ...]

DATA is a Parquet, CSV or .npz file of vectors for mixtures, a .ldac file or Parquet rows (doc_id,
ids, counts) for topics, Parquet rows (seq_id, n, x[, xprev]) for hidden Markov models and topics over
vectors, Parquet edges (src, dst, x) for block models. Options are the fields of ``Options``;
unknown ones are warned of and left out. ``init`` may also be the folder of a saved run.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import sys
import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixloom.models import likelihoods as L
from mixloom.models.hmm import HMM, fit_hmm
from mixloom.models.mixtures import DPMixture, FiniteMixture, Mixture
from mixloom.models.relational import BlockModel, fit_blocks
from mixloom.models.topics import GroupTopicModel, TopicModel, documents_as_rows, fit_group_topics, fit_topics
from mixloom.operators.datasets import with_batches
from mixloom.plans import fit as P


@dataclass
class Options:
    k: int = 6
    laps: int = 10
    tasks: int = 1
    job: str = "default"
    batches: int = 10
    init: str = "randexamples"
    tol: float = 0.05
    gamma: float = 1.0
    var: float = 1.0
    kappa: float = 1e-4
    lam: float = 0.1
    alpha: float = 0.5
    sticky: float = 0.0
    vocab: int = 0
    moves: str = ""
    output: str = ""


#: Allocation models by name: the family, and what makes it.
ALLOCS = {
    "FiniteMixture": ("mixture", lambda o: FiniteMixture(o.gamma)),
    "DPMixture": ("mixture", lambda o: DPMixture(o.gamma)),
    "FiniteTopic": ("topic", {"hdp": False}),
    "HDPTopic": ("topic", {"hdp": True}),
    "FiniteHMM": ("hmm", {"hdp": False}),
    "HDPHMM": ("hmm", {"hdp": True}),
    "FiniteSMSB": ("blocks", {"single": True}),
    "FiniteMMSB": ("blocks", {}),
    "FiniteAssortativeMMSB": ("blocks", {"assortative": True}),
    "HDPMMSB": ("blocks", {"hdp": True}),
    "HDPAssortativeMMSB": ("blocks", {"hdp": True, "assortative": True}),
}


def family(alloc: str) -> tuple:
    """(family, maker) of an allocation model, with or without ``Model`` at the end of its name."""
    name = alloc.removesuffix("Model")
    if name not in ALLOCS:
        raise ValueError(f"unknown allocation model {alloc}; known: {', '.join(ALLOCS)}")
    return ALLOCS[name]


def unique_seed(job: str, task: int = 0) -> int:
    """A seed below 10 million from the first five characters of the job's name (up to a dash) and the task."""
    name = job.split("-")[0][:5] + str(task)
    return int(hashlib.md5(name.encode()).hexdigest(), 16) % 10_000_000


def typed_options(given: dict) -> Options:
    """Options from text or values, by the types of the fields; unknown names are warned of."""
    known = {f.name: f.type for f in dataclasses.fields(Options)}
    out = {}
    for name, value in given.items():
        if name not in known:
            warnings.warn(f"unknown option {name}", stacklevel=2)
            continue
        out[name] = {"int": int, "float": float, "str": str}[known[name]](value)
    return Options(**out)


def likelihood(name: str, dim: int, o: Options) -> L.Likelihood:
    make = {
        "DiagGauss": lambda: L.DiagGauss(dim, kappa=o.kappa, var=o.var), "Gauss": lambda: L.Gauss(dim, kappa=o.kappa, cov=o.var), "ZeroMeanGauss": lambda: L.ZeroMeanGauss(dim, cov=o.var),
        "AutoRegGauss": lambda: L.AutoRegGauss(dim, cov=o.var), "Mult": lambda: L.Mult(dim, lam=o.lam), "Bern": lambda: L.Bern(dim, lam1=o.lam, lam0=o.lam),
        "GaussRegressYFromFixedX": lambda: L.GaussRegress(dim), "GaussRegressYFromDiagGaussX": lambda: L.Joint(x=L.DiagGauss(dim, var=o.var), y=L.GaussRegress(dim)),
    }
    if name not in make:
        raise ValueError(f"unknown likelihood {name}; known: {', '.join(make)}")
    return make[name]()


def _known(alg: str, algs: tuple) -> str:
    if alg not in algs:
        raise ValueError(f"unknown algorithm {alg}; known here: {', '.join(algs)}")
    return alg.lower()


def _mixture_task(df, model, alg, key, o, seed, callbacks):
    _known(alg, ("EM", "VB", "soVB", "moVB", "memoVB"))
    moves = P.Moves(**{m: True for m in o.moves.split(",") if m in ("birth", "merge", "delete", "shuffle")})
    shared = {"seed": seed, "how": o.init, "laps": o.laps, "callbacks": callbacks}
    if "/" in o.init:
        from mixloom.sources.store import RunStore

        saved = RunStore(df.sparkSession, o.init).load(part="stats")[1]
        shared |= {"how": "saved", "stats": {n: v for n, v in saved.items() if n not in ("evidence", "pair_entropy", "n")}}
    return {
        "EM": lambda: P.fit_em(df, key, model, o.k, **shared), "VB": lambda: P.fit_vb(df, key, model, o.k, tol=o.tol, **shared),
        "soVB": lambda: P.fit_sovb(df, key, model, o.k, n_batches=o.batches, **shared), "moVB": lambda: P.fit_movb(df, key, model, o.k, n_batches=o.batches, tol=o.tol, **shared),
        "memoVB": lambda: P.fit_memovb(df, key, model, o.k, n_batches=o.batches, tol=o.tol, moves=moves, **shared),
    }[alg]()


def _task(df, kind, model, alg, key, o, seed, callbacks) -> P.FitResult:
    if kind == "mixture":
        return _mixture_task(df, model, alg, key, o, seed, callbacks)
    if kind == "blocks":
        _known(alg, ("VB",))
        *_, params, losses = fit_blocks(df, model, o.k, laps=o.laps, seed=seed)
        return P.FitResult(params, {}, [{"lap": i + 1.0, "loss": float(v), "k": o.k} for i, v in enumerate(losses)], uids=list(range(o.k)))
    if isinstance(model, GroupTopicModel):
        _known(alg, ("VB",))
        return fit_group_topics(df, model, o.k, laps=o.laps, seed=seed)
    kept = {"alg": _known(alg, ("VB", "soVB", "memoVB")), "laps": o.laps, "n_batches": o.batches, "seed": seed, "tol": o.tol}
    return fit_hmm(df, model, o.k, **kept) if kind == "hmm" else fit_topics(df, model, o.k, callbacks=callbacks, **kept)


def model_of(df: DataFrame, alloc: str, obs: str, o: Options):
    """The model for the rows of ``df``; what has a dimension learns it from the first row, words from ``vocab`` or the largest id."""
    kind, make = family(alloc)
    if kind == "blocks":
        return BlockModel(alpha=o.alpha, lam1=o.lam, lam0=o.lam, **make)
    if kind == "topic" and obs == "Mult":
        v = o.vocab or df.agg(F.max(F.array_max("ids"))).first()[0] + 1
        return TopicModel(v, alpha=o.alpha, lam=o.lam, **make)
    if "ids" in df.columns:
        dim = o.vocab or df.agg(F.max(F.array_max("ids"))).first()[0] + 1
    else:
        first = df.where(F.size("x") > 0).first()
        dim = len(first["x"]) // (first["n"] if kind != "mixture" else 1)
    like = likelihood(obs, dim, o)
    if kind == "mixture":
        return Mixture(make(o), like)
    return HMM(like, kappa=o.sticky, **make) if kind == "hmm" else GroupTopicModel(like, alpha=o.alpha, **make)


def run(df: DataFrame, alloc: str, obs: str, alg: str, *, key: str = "row_id", **options) -> tuple[object, P.FitResult, dict]:
    """Fits every task and returns (model, best result, {task: final loss}); the first of equal losses wins."""
    o, (kind, _) = typed_options(options), family(alloc)
    model = model_of(df, alloc, obs, o)
    key = {"mixture": key, "topic": "doc_id" if "doc_id" in df.columns else "seq_id", "hmm": "seq_id", "blocks": "src"}[kind]
    if alg in ("soVB", "moVB", "memoVB") and "batch_id" not in df.columns:
        df = with_batches(df, key, o.batches)
    best, losses = None, {}
    for task in range(o.tasks):
        store, callbacks = None, []
        if o.output:
            from mixloom.sources.store import RunStore

            store = RunStore(df.sparkSession, f"{o.output}/{o.job}/{task + 1}")
            callbacks = [store.callback()]
        result = _task(df, kind, model, alg, key, o, unique_seed(o.job, task), callbacks)
        losses[task] = result.losses[-1]
        if store:
            store.log_trace(result.trace)
            store.log_moves(result.moves)
            store.save(result.trace[-1]["lap"], result.params)
            if result.stats:
                store.save(result.trace[-1]["lap"], result.stats, "stats")
        if best is None or losses[task] < best.losses[-1]:
            best = result
    return model, best, losses


def main(args: list[str]) -> None:
    from mixloom.sources.readers import read_ldac, read_vectors

    data, alloc, obs, alg, *rest = args
    options = {rest[i].lstrip("-"): rest[i + 1] for i in range(0, len(rest) - 1, 2)}
    spark = SparkSession.builder.appName("mixloom").getOrCreate()
    if family(alloc)[0] == "mixture":
        df = read_vectors(spark, data)
    else:
        df = documents_as_rows(read_ldac(spark, data)) if data.endswith(".ldac") else spark.read.parquet(data)
    if family(alloc)[0] == "mixture" and "row_id" not in df.columns:
        df = df.withColumn("row_id", F.monotonically_increasing_id())
    model, best, losses = run(df, alloc, obs, alg, **options)
    print(json.dumps({"model": model.name, "losses": losses, "trace": best.trace}))


if __name__ == "__main__":
    main(sys.argv[1:])
