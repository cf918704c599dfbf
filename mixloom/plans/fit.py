"""Fitting mixtures: EM, VB, stochastic VB, memoized VB, and moves that change the number of components.

A lap is one pass: executors score rows and add up statistics (``distributed.summed``); the
driver does K-sized algebra. Memoized algorithms keep one block of statistics per batch, so
the total is exact whatever the order of batches: total = total - old batch + new batch.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixloom.functions.numeric import big_to_small
from mixloom.models.mixtures import Mixture, merge_components, remove_components, reorder_components
from mixloom.plans.distributed import column_matrix, summed


@dataclass
class Event:
    """What callbacks get: which moment, at which lap, with what state."""

    moment: str
    lap: float
    loss: float
    k: int
    stats: dict
    params: dict
    uids: list[int] = field(default_factory=list)
    seconds: float = 0.0


@dataclass
class FitResult:
    params: dict
    stats: dict
    trace: list[dict] = field(default_factory=list)
    moves: list[dict] = field(default_factory=list)
    uids: list[int] = field(default_factory=list)
    converged: bool = False
    began: float = field(default_factory=time.monotonic)

    @property
    def losses(self) -> list[float]:
        return [t["loss"] for t in self.trace]


#: Cells of the dense block into which sparse rows are spread for scoring.
DENSE_CELLS = 4_000_000


def batch_columns(df: DataFrame) -> list[str]:
    return [c for c in ("x", "xprev", "y", "ids", "counts") if c in df.columns]


def as_batch(record, cols: list[str], width: int | None = None) -> dict:
    """Numpy arrays of a record batch; sparse rows (ids, counts) become dense rows ``x`` of ``width``."""
    if "ids" not in cols:
        return {c: column_matrix(record, c) for c in cols}
    x = np.zeros((record.num_rows, width))
    for i, (ids, counts) in enumerate(zip(record.column("ids").to_pylist(), record.column("counts").to_pylist())):
        np.add.at(x[i], np.asarray(ids or [], int), np.asarray(counts or [], float))
    return {"x": x}


def batches_of(records, cols: list[str], model: Mixture):
    """(record, batch) pairs, sparse ones cut so that the dense block stays small."""
    width = getattr(model.obs, "vocab", getattr(model.obs, "dim", None))
    for r in records:
        step = max(1, DENSE_CELLS // width) if "ids" in cols else max(1, r.num_rows)
        for at in range(0, r.num_rows, step):
            part = r.slice(at, step)
            yield part, as_batch(part, cols, width)


def one_pass(df: DataFrame, score_of: Callable[[dict], np.ndarray], model: Mixture, *, keep: int | None = None, pairs=()) -> dict | None:
    """Statistics of all rows under the given scoring."""
    cols = batch_columns(df)

    def step(records):
        for r, b in batches_of(records, cols, model):
            yield model.summary(b, score_of(b), keep, pairs) | {"n": np.array([r.num_rows])}

    return summed(df.select(*cols), step)


def draw_rows(df: DataFrame, key: str, k: int, seed: int) -> list:
    """k rows chosen by hash of key and seed: the same on any partitioning."""
    h = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    return df.orderBy(h, key).limit(k).collect()


def _as_rows(rows, cols, model):
    if "ids" in cols:
        x = np.zeros((len(rows), getattr(model.obs, "vocab", getattr(model.obs, "dim", None))))
        for i, r in enumerate(rows):
            np.add.at(x[i], np.asarray(r["ids"], int), np.asarray(r["counts"], float))
        return {"x": x}
    return {c: np.array([r[c] for r in rows], dtype=float) for c in cols}


def init_stats(df: DataFrame, key: str, model: Mixture, k: int, *, seed: int = 0, how: str = "randexamples") -> dict:
    """First statistics from data: ``randexamples`` (k random rows as single-row components),
    ``randexamplesbydist`` (rows drawn with chance proportional to the squared distance to
    those drawn before), ``kmeans`` (the latter, then Lloyd steps), ``bregman`` (drawn and
    refined by the likelihood's own divergence), ``contigblocks`` (k even stretches by key),
    ``truth`` (column ``label`` of 0 to k - 1; rows without one are left out), ``resp`` (column
    ``resp``, k responsibilities a row)."""
    cols = batch_columns(df)
    if how == "truth":
        known = df.where(F.col("label").between(0, k - 1))
        return _stats_by_label(known.withColumn("_z", F.col("label")), cols, model, k) | {"n": np.array([float(known.count())])}
    if how == "resp":
        return _stats_by_resp(df, cols, model, k) | {"n": np.array([float(df.count())])}
    if how == "contigblocks":
        n = df.count()
        first = df.select(key).orderBy(key)
        cuts = first.agg(F.percentile(key, F.array(*[F.lit(i / k) for i in range(1, k)]))).first()[0] if k > 1 else []
        place = sum((F.col(key) >= c).cast("int") for c in cuts) if k > 1 else F.lit(0)
        return _stats_by_label(df.withColumn("_z", place), cols, model, k) | {"n": np.array([float(n)])}
    rows = draw_rows(df, key, 1 if how != "randexamples" else k, seed)
    if not rows:
        raise ValueError("no rows to start from")
    if how != "randexamples":
        rng = np.random.RandomState(seed)
        while len(rows) < k:
            centres = _as_rows(rows, cols, model)
            own = _one_hot_stats(model, centres)
            spread = None if how != "bregman" else own

            def gaps(b):
                d = model.obs.divergence(b, spread) if spread is not None else ((b["x"][:, None, :] - centres["x"][None]) ** 2).sum(2)
                return d.min(1)

            nxt = _weighted_draw(df, key, cols, model, gaps, int(rng.randint(1 << 30)))
            if nxt is None:
                break  # fewer distinct rows than components
            rows.append(nxt)
    stats = _one_hot_stats(model, _as_rows(rows, cols, model))
    for _ in range({"kmeans": 5, "bregman": 3}.get(how, 0)):
        if how == "bregman":
            score = lambda b, s=stats: -1e6 * model.obs.divergence(b, s)
        else:
            m = stats["x"] / np.maximum(stats["N"], 1e-300)[:, None]
            score = lambda b, m=m: -1e6 * ((b["x"][:, None, :] - m[None]) ** 2).sum(2)
        old, stats = stats["N"], one_pass(df, score, model, keep=1)
        stats = remove_components(stats, [i for i, n in enumerate(stats["N"]) if n < 0.5], len(stats["N"]))
        if len(stats["N"]) == len(old) and np.allclose(stats["N"], old):
            break
    order = big_to_small(stats["N"])
    return reorder_components({k2: v for k2, v in stats.items() if k2 not in ("evidence", "n")}, order)


def _one_hot_stats(model: Mixture, rows: dict) -> dict:
    n = len(next(iter(rows.values())))
    return model.obs.stats(rows, np.eye(n)) | {"entropy": np.zeros(n)}


def _stats_by_label(df, cols, model, k):
    def step(records):
        for r, b in batches_of(records, cols, model):
            z = column_matrix(r, "_z").astype(int)
            yield model.obs.stats(b, np.eye(k)[z]) | {"entropy": np.zeros(k)}

    return summed(df.select(*cols, F.col("_z").cast("double").alias("_z")), step)


def _stats_by_resp(df, cols, model, k):
    def step(records):
        for r, b in batches_of(records, cols, model):
            resp = column_matrix(r, "resp").reshape(-1, k)
            yield model.obs.stats(b, resp) | {"entropy": -(resp * np.log(np.maximum(resp, 1e-300))).sum(0)}

    return summed(df.select(*cols, F.col("resp").cast("array<double>").alias("resp")), step)


def _weighted_draw(df, key, cols, model, weight_of, seed):
    """One row with chance proportional to its weight: the smallest -ln(u) / weight over all rows."""

    def step(records):
        import hashlib

        import pyarrow as pa

        best = None
        for r, b in batches_of(records, cols, model):
            w = weight_of(b)
            for i, k in enumerate(r.column(key).to_pylist()):
                if w[i] > 0:
                    u = (int(hashlib.md5(f"{k}|{seed}".encode()).hexdigest()[:12], 16) + 1) / (16**12 + 1)
                    s = -math.log(u) / w[i]
                    if best is None or (s, k) < best:
                        best = (s, k)
        if best:
            yield pa.RecordBatch.from_pydict({"s": pa.array([best[0]]), "k": pa.array([best[1]], pa.int64())})

    found = df.select(F.col(key).cast("bigint").alias(key), *cols).mapInArrow(step, "s double, k bigint").orderBy("s", "k").first()
    return None if found is None else df.where(F.col(key) == found["k"]).first()


def _trace(result, lap, loss, stats, callbacks, params, moment="lap", uids=None):
    """Notes a step (lap, loss, k, seconds since the start, rows behind the statistics) and calls the callbacks."""
    uids, seconds = list(result.uids if uids is None else uids), time.monotonic() - result.began
    rows = float(stats["n"][0]) if "n" in stats else float(np.sum(stats["N"]))
    result.trace.append({"lap": lap, "loss": float(loss), "k": len(stats["N"]), "seconds": seconds, "rows": rows})
    for c in callbacks:
        c(Event(moment, lap, loss, len(stats["N"]), stats, params, uids, seconds))


def should_save(lap: float, n_steps: int, *, every: float = 5, early: float = 0) -> bool:
    """Whether a checkpoint is due: the first steps, laps 1, 2, 4, 8, each whole lap up to ``early``, then every ``every``."""
    whole = abs(lap - round(lap)) < 1e-9
    return n_steps < 3 or (whole and (lap in (1, 2, 4, 8) or lap <= early or lap % every == 0))


def fit_em(df: DataFrame, key: str, model: Mixture, k: int, *, laps: int = 10, tol: float = 1e-4, seed: int = 0, how: str = "randexamples", stats: dict | None = None, callbacks=()) -> FitResult:
    """Expectation maximisation; the loss of a lap is that of the parameters it began with."""
    stats = stats or init_stats(df, key, model, k, seed=seed, how=how)
    if how not in ("truth", "resp"):
        stats = one_pass(df, model.scorer(model.global_step(stats)), model)  # single rows have no spread to start from
    params, result = model.em_step(stats), FitResult({}, {}, uids=list(range(len(stats["N"]))))
    for lap in range(1, laps + 1):
        stats = one_pass(df, model.em_scorer(params), model)
        loss = -(stats["evidence"][0] + model.alloc.em_log_prior(params["weights"])) / model.scale(stats["n"][0])
        _trace(result, lap, loss, stats, callbacks, params)
        params = model.em_step(stats)
        if lap > 1 and abs(result.losses[-1] - result.losses[-2]) < tol:
            result.converged = True
            break
    result.params, result.stats = params, stats
    return result


def fit_vb(df: DataFrame, key: str, model: Mixture, k: int, *, laps: int = 10, tol: float = 0.05, seed: int = 0, how: str = "randexamples", keep: int | None = None, stats: dict | None = None, callbacks=()) -> FitResult:
    """Variational Bayes over all rows per lap; stops when no count changes by ``tol``."""
    stats = stats or init_stats(df, key, model, k, seed=seed, how=how)
    params, result = model.global_step(stats), FitResult({}, {}, uids=list(range(len(stats["N"]))))
    for lap in range(1, laps + 1):
        before, stats = stats["N"], one_pass(df, model.scorer(params), model, keep=keep)
        params = model.global_step(stats)
        _trace(result, lap, -model.objective(stats) / model.scale(stats["n"][0]), stats, callbacks, params)
        if lap > 1 and np.abs(stats["N"] - before).max() < tol:
            result.converged = True
            break
    result.params, result.stats = params, stats
    return result


def learning_rate(step: int, *, delay: float = 1.0, power: float = 0.5) -> float:
    return (1 + step + delay) ** -power


def batch_order(n_batches: int, lap: int, seed: int) -> np.ndarray:
    """The order of batches in a lap."""
    return np.random.RandomState((seed + lap) % (1 << 31)).permutation(n_batches)


def fit_sovb(df: DataFrame, key: str, model: Mixture, k: int, *, n_batches: int = 10, laps: int = 1, seed: int = 0, how: str = "randexamples", delay: float = 1.0, power: float = 0.5, stats: dict | None = None, callbacks=()) -> FitResult:
    """Stochastic VB: each batch's statistics, amplified to the whole, move the natural parameters."""
    stats0 = stats or init_stats(df, key, model, k, seed=seed, how=how)
    sizes = {r["batch_id"]: r["count"] for r in df.groupBy("batch_id").count().collect()}
    total, params = sum(sizes.values()), model.global_step(stats0)
    result, step = FitResult({}, {}, uids=list(range(len(stats0["N"])))), 0
    for lap in range(1, laps + 1):
        for done, b in enumerate(batch_order(n_batches, lap, seed), 1):
            if not sizes.get(int(b)):
                continue
            part = one_pass(df.where(F.col("batch_id") == int(b)), model.scorer(params), model)
            factor = total / sizes[int(b)]
            params = model.stochastic_step(params, part, learning_rate(step, delay=delay, power=power), factor)
            step += 1
            whole = {n: v * factor for n, v in part.items()}
            _trace(result, lap - 1 + done / n_batches, -model.objective(whole, params) / model.scale(total), whole, callbacks, params, "batch")
            stats0 = whole
    result.params, result.stats = params, stats0
    return result


@dataclass
class Moves:
    """Which moves a memoized fit makes after each lap, and their limits."""

    merge: bool = False
    delete: bool = False
    birth: bool = False
    shuffle: bool = False
    start_lap: int = 2
    pairs_per_component: int = 5
    delete_size: float = 50_000
    k_max: int = 100
    k_fresh: int = 3
    birth_least: float = 0.1
    tolerance: float = 1e-6
    retry_laps: int = 5


def merge_shortlist(n: np.ndarray, per_component: int) -> list[tuple[int, int]]:
    """Pairs by total size, largest first, each component in at most ``per_component`` of them."""
    k, used, out = len(n), np.zeros(len(n), int), []
    pairs = [(-(n[a] + n[b]), a, b) for a in range(k) for b in range(a + 1, k)]
    for _, a, b in sorted(pairs):
        if used[a] < per_component and used[b] < per_component:
            used[[a, b]] += 1
            out.append((a, b))
    return out


class Memo:
    """Per-batch statistics under component uids, their total, and the log of changes.

    Every change of components is applied to all batches' blocks at once, so old and new
    blocks always have the same components.
    """

    def __init__(self, stats: dict):
        self.blocks: dict[int, dict] = {}
        self.uids = list(range(len(stats["N"])))
        self.next_uid = len(self.uids)

    def total(self) -> dict:
        out: dict = {}
        for block in self.blocks.values():
            for k, v in block.items():
                out[k] = out[k] + v if k in out else v.copy()
        return out

    def replace(self, batch: int, block: dict) -> None:
        self.blocks[batch] = block

    def merge(self, a: int, b: int, pair: int | None) -> None:
        for i, s in self.blocks.items():
            exact = float(s["pair_entropy"][pair]) if pair is not None and "pair_entropy" in s else None
            self.blocks[i] = merge_components(s, a, b, exact)
        self.uids.pop(b)

    def reorder(self, order) -> None:
        for i, s in self.blocks.items():
            self.blocks[i] = reorder_components(s, order)
        self.uids = [self.uids[i] for i in order]

    def fresh_uids(self, n: int) -> list[int]:
        self.next_uid += n
        return list(range(self.next_uid - n, self.next_uid))


def fit_memovb(df: DataFrame, key: str, model: Mixture, k: int, *, n_batches: int = 10, laps: int = 5, tol: float = 0.01, seed: int = 0, how: str = "randexamples", moves: Moves | None = None, keep: int | None = None, stats: dict | None = None, callbacks=()) -> FitResult:
    """Memoized VB over fixed batches (``df.batch_id``), with optional moves after each lap.

    A batch is scored under the current parameters, its old block replaced, and the global step
    taken on the exact total. Store large data by batch (``datasets.stored_batches``), so that a
    pass over a batch reads no other. Moves are judged by the objective of the whole; the loss never
    rises but for the entropy bound of unpaired merges, which are not proposed.
    """
    stats = stats or init_stats(df, key, model, k, seed=seed, how=how)
    params, memo, result = model.global_step(stats), Memo(stats), FitResult({}, {})
    n_total = df.count()
    tried: dict[tuple, int] = {}
    moves = moves or Moves()
    for lap in range(1, laps + 1):
        plan = merge_shortlist(memo.total()["N"], moves.pairs_per_component) if moves.merge and lap >= moves.start_lap and memo.blocks else []
        plan = [p for p in plan if tried.get((memo.uids[p[0]], memo.uids[p[1]]), -99) + moves.retry_laps <= lap]
        change = 0.0
        for done, b in enumerate(batch_order(n_batches, lap, seed), 1):
            part = one_pass(df.where(F.col("batch_id") == int(b)), model.scorer(params), model, keep=keep, pairs=plan)
            if part is None:
                continue
            old = memo.blocks.get(int(b))
            change = max(change, np.abs(part["N"] - old["N"]).max() if old is not None and len(old["N"]) == len(part["N"]) else math.inf)
            memo.replace(int(b), part)
            total = memo.total() if plan == [] else {k2: v for k2, v in _sum_blocks(memo.blocks).items()}
            params = model.global_step(total)
            if len(memo.blocks) == n_batches or done == n_batches:
                _trace(result, lap - 1 + done / n_batches, -model.objective(total) / model.scale(n_total), total, callbacks, params, "batch", memo.uids)
        moved = _after_lap(df, key, model, memo, plan, moves, lap, seed, result, tried, n_total)
        if moved:
            total = _sum_blocks(memo.blocks)
            params = model.global_step(total)
            _trace(result, lap, -model.objective(total) / model.scale(n_total), total, callbacks, params, "moves", memo.uids)
        if not moved and lap > 1 and change < tol:
            result.converged = True
            break
    total = _sum_blocks(memo.blocks)
    result.params, result.stats, result.uids = model.global_step(total), total, memo.uids
    return result


fit_movb = fit_memovb  # without moves the two are one algorithm


def _sum_blocks(blocks: dict[int, dict]) -> dict:
    out: dict = {}
    for block in blocks.values():
        for k, v in block.items():
            if k != "pair_entropy":
                out[k] = out[k] + v if k in out else v.copy()
    return out


def _after_lap(df, key, model, memo, plan, moves, lap, seed, result, tried, n_total) -> bool:
    moved = False
    log = lambda kind, ok, **x: result.moves.append({"lap": lap, "move": kind, "accepted": ok} | x)
    if moves.birth and len(memo.uids) < moves.k_max:
        moved |= _birth(df, key, model, memo, moves, lap, seed, log)
    if moves.delete and lap >= moves.start_lap and len(memo.uids) > 1:
        moved |= _delete(df, model, memo, moves, log, lap, tried)
    if plan and not moved:
        taken: set[int] = set()
        uids = list(memo.uids)
        for i, (a, b) in enumerate(plan):
            if a in taken or b in taken:
                continue
            ua, ub = uids[a], uids[b]
            ka, kb = memo.uids.index(ua), memo.uids.index(ub)
            now = _sum_blocks(memo.blocks)
            exact = sum(float(s["pair_entropy"][i]) for s in memo.blocks.values())
            after = merge_components(now, ka, kb, exact)
            ok = model.objective(after) >= model.objective(now) - moves.tolerance * model.scale(n_total)
            tried[(ua, ub)] = lap
            log("merge", ok, uids=(ua, ub))
            if ok:
                memo.merge(ka, kb, i)
                taken |= {a, b}
                moved = True
    for s in memo.blocks.values():
        s.pop("pair_entropy", None)
    if moves.shuffle:
        total = _sum_blocks(memo.blocks)
        order = big_to_small(total["N"])
        if (order != np.arange(len(order))).any():
            memo.reorder(order)
            log("shuffle", True)
            moved = True
        total = _sum_blocks(memo.blocks)
        small = [i for i, n in enumerate(total["N"]) if n < 1e-3]
        if small and len(small) < len(memo.uids):
            blocks = _rescored(df, model, model.global_step(remove_components(total, small, len(memo.uids))), memo)
            ok = model.objective(_sum_blocks(blocks)) >= model.objective(total) - moves.tolerance * model.scale(n_total)
            log("prune", ok, uids=tuple(memo.uids[i] for i in small))
            if ok:
                memo.uids = [u for i, u in enumerate(memo.uids) if i not in set(small)]
                memo.blocks = blocks
                moved = True
    return moved


def _rescored(df, model, params, memo) -> dict[int, dict]:
    """Fresh blocks of all batches under given parameters."""
    out = {}
    for b in memo.blocks:
        out[b] = one_pass(df.where(F.col("batch_id") == int(b)), model.scorer(params), model)
    return out


def delete_target(sizes, most: float, barred=()) -> int | None:
    """The largest component of at most ``most``, the first of equal ones; None if there is none."""
    fits = [(float(n), -i) for i, n in enumerate(sizes) if n <= most and i not in barred]
    return -max(fits)[1] if fits else None


def _delete(df, model, memo, moves, log, lap, tried) -> bool:
    """Removes the largest component within the size limit if the rest explains its rows better.

    A component that could not be removed is left alone for ``retry_laps`` laps."""
    now = _sum_blocks(memo.blocks)
    barred = {i for i, u in enumerate(memo.uids) if tried.get((u,), -99) + moves.retry_laps > lap}
    target = delete_target(now["N"], moves.delete_size, barred)
    if target is None:
        return False
    tried[(memo.uids[target],)] = lap
    params = model.global_step(remove_components(now, [target], len(memo.uids)))
    blocks = _rescored(df, model, params, memo)
    ok = model.objective(_sum_blocks(blocks)) >= model.objective(now) - moves.tolerance * model.scale(now["n"][0])
    log("delete", ok, uids=(memo.uids[target],))
    if ok:
        memo.blocks = blocks
        memo.uids.pop(target)
    return ok


def _birth(df, key, model, memo, moves, lap, seed, log) -> bool:
    """Splits the component of the worst fit: its rows seed fresh components, refined over all
    batches; kept only if the objective of the whole strictly rises."""
    now = _sum_blocks(memo.blocks)
    params = model.global_step(now)
    per_row = model.obs.log_marginal(now) / np.maximum(now["N"], 1e-9)
    able = [i for i, n in enumerate(now["N"]) if n >= 2 * moves.k_fresh]
    if not able:
        return False
    target = sorted(able, key=lambda i: per_row[i])[lap % len(able)]
    score, cols = model.scorer(params), batch_columns(df)

    def own(records):
        import pyarrow as pa

        for r, b in batches_of(records, cols, model):
            if r.num_rows:
                s = score(b)
                top = s - s.max(1, keepdims=True)
                resp = np.exp(top) / np.exp(top).sum(1, keepdims=True)
                yield r.filter(pa.array(resp[:, target] > moves.birth_least))

    rows = df.select(F.col(key).cast("bigint").alias(key), *cols)
    targeted = rows.mapInArrow(own, rows.schema)
    drawn = draw_rows(targeted, key, moves.k_fresh, seed + lap)
    if len(drawn) < 2:
        return False
    fresh = _one_hot_stats(model, _as_rows(drawn, cols, model))
    # the fresh components share the target's mass; the target itself goes
    share = now["N"][target] / len(drawn)
    fresh = {k2: v * share for k2, v in fresh.items()}
    base = remove_components(now, [target], len(memo.uids))
    grown = {k2: np.concatenate([base[k2], fresh[k2]]) if k2 in fresh else base[k2] for k2 in base}
    blocks, best = None, None
    for _ in range(3):
        blocks = _rescored(df, model, model.global_step(grown), memo)
        grown = _sum_blocks(blocks)
        best = model.objective(grown)
    uids = [u for i, u in enumerate(memo.uids) if i != target]
    small = [i for i, n in enumerate(grown["N"]) if n < 1]
    if small:
        # scored again without them, so that no row loses mass
        blocks = _rescored(df, model, model.global_step(remove_components(grown, small, len(grown["N"]))), memo)
        best = model.objective(_sum_blocks(blocks))
    ok = best > model.objective(now)
    log("birth", ok, uids=(memo.uids[target],))
    if ok:
        every = uids + memo.fresh_uids(len(drawn))
        memo.uids = [u for i, u in enumerate(every) if i not in set(small)]
        memo.blocks = blocks
    return ok


def fit_gibbs(df: DataFrame, key: str, model: Mixture, k: int, *, sweeps: int = 10, seed: int = 0, most: int = 100_000) -> FitResult:
    """Collapsed Gibbs sampling over at most ``most`` rows (else an error): each row leaves its component
    and draws a new one by prior count times the predictive density. Sequential by nature, so it
    runs on the driver; the loss is minus the log marginal likelihood per row, and need not fall."""
    cols = batch_columns(df)
    rows = df.select(key, *cols).orderBy(key).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"collapsed Gibbs sampling is for at most {most} rows")
    batch, rng, obs = _as_rows(rows, cols, model), np.random.RandomState(seed), model.obs
    one = [obs.increments(obs.stats({c: v[i : i + 1] for c, v in batch.items()}, np.ones((1, 1)))) for i in range(len(rows))]
    z = rng.randint(k, size=len(rows))
    stats = obs.stats(batch, np.eye(k)[z])
    nat, n = obs.nat(stats), np.bincount(z, minlength=k).astype(float)
    share = getattr(model.alloc, "gamma", getattr(model.alloc, "gamma0", 1.0)) / k
    result = FitResult({}, {}, uids=list(range(k)))
    for sweep in range(1, sweeps + 1):
        for i in rng.permutation(len(rows)):
            for p in nat:
                nat[p][z[i]] -= one[i][p][0]
            n[z[i]] -= 1
            with_row = {p: nat[p] + one[i][p] for p in nat}
            log_p = np.log(n + share) + obs.cumulant(obs.post(nat)) - obs.cumulant(obs.post(with_row))
            w = np.exp(log_p - log_p.max())
            z[i] = np.searchsorted(np.cumsum(w), rng.rand() * w.sum())
            for p in nat:
                nat[p][z[i]] += one[i][p][0]
            n[z[i]] += 1
        stats = obs.stats(batch, np.eye(k)[z]) | {"entropy": np.zeros(k)}
        nat = obs.nat(stats)  # no drift from adding and taking away
        result.trace.append({"lap": sweep, "loss": -model.objective(stats) / model.scale(len(rows)), "k": k})
    result.params, result.stats = model.global_step(stats), stats
    return result


def assign(df: DataFrame, key: str, model: Mixture, params: dict) -> DataFrame:
    """(key, component, log_evidence) of each row; the lowest component on ties."""
    score, cols = model.scorer(params), batch_columns(df)

    def step(records):
        import pyarrow as pa

        from mixloom.functions.numeric import log_sum_exp

        for r, b in batches_of(records, cols, model):
            if r.num_rows:
                s = score(b)
                yield pa.RecordBatch.from_pydict({key: r.column(key), "component": pa.array(s.argmax(1).astype(np.int32)), "log_evidence": pa.array(log_sum_exp(s))})

    return df.select(F.col(key).cast("bigint").alias(key), *cols).mapInArrow(step, f"{key} bigint, component int, log_evidence double")




def predict(df: DataFrame, key: str, model: Mixture, params: dict, part: str = "y") -> DataFrame:
    """(key, y_hat, by_component) of a mixture with a regression under ``part`` of a joint likelihood:
    each component's prediction, and their mean weighted by what x alone says of the component."""
    joint, cols = model.obs, [c for c in batch_columns(df) if c != "y"]
    reg, rest = joint.parts[part], {n: p for n, p in joint.parts.items() if n != part}
    post, log_w = joint.post(params["obs"]), model.alloc.log_weights(params["alloc"])
    own = joint._of(part, post)

    def step(records):
        import pyarrow as pa

        from mixloom.functions.numeric import exp_normalise

        for r, b in batches_of(records, cols, model):
            if r.num_rows:
                scores = np.tile(log_w, (r.num_rows, 1)) + sum((p.score(b, joint._of(n, post)) for n, p in rest.items()), 0.0)
                each = reg.predict(b, own)
                mean = (exp_normalise(scores)[0] * each).sum(1)
                yield pa.RecordBatch.from_pydict({key: r.column(key), "y_hat": pa.array(mean), "by_component": pa.array(each.tolist(), pa.list_(pa.float64()))})

    return df.select(F.col(key).cast("bigint").alias(key), *cols).mapInArrow(step, f"{key} bigint, y_hat double, by_component array<double>")
