"""Events, runs and frequent subsequences against brute force."""

import itertools
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from mixloom.llm.events import events, proper_names
from mixloom.llm.runs import collapse_runs
from mixloom.llm.subsequences import frequent_subsequences

STEPS = "seq_id bigint, tstep_id int, action_name string, logged_at timestamp, action string, block string"
T0 = datetime(2024, 1, 1)
NAMES = ["HeelDig", "RopeSwing", "CatStretch", "BoxLift"]


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([(i, n, "x") for i, n in enumerate(NAMES)], "action_id int, action_name string, bare string")


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], STEPS)


def test_spellings(spark, names):
    cases = {
        "HeelDig": "HeelDig", "heel-dig": "HeelDig", " HEEL_DIG\t": "HeelDig", "hel dig": "HeelDig", "HeeelDig": "HeelDig", "HeelDog": "HeelDig", "HeelDgi": "HeelDig",
        "ehel.dig": "HeelDig", "rope swin": "RopeSwing", "totally else": "(totallyelse)", "": None, "  ": None, "--": None, None: None, "x" * 5000: "(" + "x" * 5000 + ")",
    }
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    assert {r.n: r.action for r in proper_names(df, "n", names).collect()} == cases
    none = proper_names(df, "n", names.where("action_id < 0"))
    assert {r.action for r in none.where("n = 'heel-dig'").collect()} == {"(heeldig)"}


def test_latest_logging_counts(spark, names):
    t1, t2 = T0, T0 + timedelta(hours=1)
    rows = [(1, 0, "HeelDig", t1), (1, 0, "BoxLift", t2), (1, 0, "HeelDig", t1), (1, 1, "BoxLift", t1), (1, 1, "RopeSwing", t1), (1, 2, "BoxLift", None), (1, 2, "HeelDig", t1), (1, 3, " ", t2), (1, 3, "HeelDig", t1), (None, 0, "HeelDig", t1), (1, None, "HeelDig", t1), (1, 4, None, t1)]
    got = {(r.seq_id, r.tstep_id): r.action for r in events(table(spark, rows), names, block=16).collect()}
    assert got == {(1, 0): "BoxLift", (1, 1): "RopeSwing", (1, 2): "HeelDig", (1, 3): "HeelDig"}


def random_steps(rng, n_seqs, length, hot=0):
    rows = []
    for s in range(n_seqs):
        t, a = rng.randint(-8, 8), 0
        for _ in range(hot if s == 0 and hot else rng.randint(1, length)):
            if rng.random() < 0.3:
                a = rng.randrange(len(NAMES))
            rows.append((s, t, NAMES[a], T0))
            t += 1 if rng.random() < 0.9 else rng.randint(2, 9)
    rng.shuffle(rows)
    return rows


def by_sequence(rows):
    seqs = defaultdict(dict)
    for s, t, a, _ in rows:
        seqs[s][t] = a
    return {s: sorted(d.items()) for s, d in seqs.items()}


def brute_runs(rows, gap=5):
    out = set()
    for s, line in by_sequence(rows).items():
        run = [line[0]]
        for cur in [*line[1:], None]:
            if cur and cur[1] == run[-1][1] and cur[0] - run[-1][0] <= gap:
                run.append(cur)
            else:
                out.add((s, run[0][1], run[0][0], run[-1][0], len(run), run[-1][0] - run[0][0]))
                run = [cur]
    return out


@pytest.mark.parametrize("seed,block,piece", [(0, 6, 4), (1, 8, 1), (2, 512, 1), (3, 512, 4)])
def test_runs_against_brute_force(spark, names, seed, block, piece):
    rng = random.Random(seed)
    rows = random_steps(rng, 12, 40, hot=400)
    rows += [(77, t, "BoxLift", T0) for t in range(150)]  # one run over many blocks
    got = {tuple(r) for r in collapse_runs(table(spark, rows + rows[:30]), names, block=block, piece=piece).collect()}
    assert got == brute_runs(rows)


def test_no_events(spark, names):
    empty = table(spark, [])
    assert collapse_runs(empty, names).count() == 0
    assert frequent_subsequences(empty, names).count() == 0
    blank = table(spark, [(1, 1, " ", T0), (None, 2, "HeelDig", T0)])
    assert collapse_runs(blank, names).count() == 0 and frequent_subsequences(blank, names).count() == 0
    with pytest.raises(ValueError):
        collapse_runs(empty, names, block=5)


def brute_patterns(rows, share, between, lengths):
    seqs = by_sequence(rows)
    held = defaultdict(set)
    for s, line in seqs.items():
        items = [a for a, _ in itertools.groupby(a for _, a in line)]
        for n in lengths:
            for at in itertools.combinations(range(len(items)), n):
                if all(b - a <= between + 1 for a, b in zip(at, at[1:])):
                    held[(">".join(items[i] for i in at), n)].add(s)
    return {(p, n, len(v)) for (p, n), v in held.items() if len(v) >= share * len(seqs)}


@pytest.mark.parametrize("seed,block,nodes", [(0, 4096, 400_000), (1, 8, 50), (2, 5, 10)])
def test_patterns_against_brute_force(spark, names, seed, block, nodes):
    rng = random.Random(seed)
    rows = [(s, t, rng.choice(NAMES), T0) for s in range(14) for t in range(rng.randint(1, 14))]
    got = {(r.pattern, r["length"], r.support) for r in frequent_subsequences(table(spark, rows + rows[:9]), names, min_share=0.3, block=block, max_nodes=nodes).collect()}
    assert got == brute_patterns(rows, 0.3, 2, (3, 4)) and got


def test_unknown_names_hold_their_place(spark, names):
    rows = [(1, i, a, T0) for i, a in enumerate(["HeelDig", "??unknown??", "??other one??", "and a third", "BoxLift", "CatStretch"])]
    got = {r.pattern for r in frequent_subsequences(table(spark, rows), names).collect()}
    assert got == set()  # HeelDig is three other items away
    got = {r.pattern for r in frequent_subsequences(table(spark, [r for r in rows if r[1] != 3]), names).collect()}
    assert got == {"HeelDig>BoxLift>CatStretch"}
