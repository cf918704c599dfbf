"""Splits, term counts and packing."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixloom.llm import terms as TM
from mixloom.llm.packing import pack, pack_windows, sum_of_squares
from mixloom.llm.splits import assign_splits, connected_components, greedy_quotas, tied_groups
from mixloom.llm.tokens import DEFAULT_TOKENIZER, encoding

TRIALS = "seq_id bigint, subj_uid bigint, uid string, component string"
ALIASES = "subj_uid bigint, alias_uid bigint, node string"


def components(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("per_task", [7, 60, 1_000_000])
def test_components(spark, per_task):
    rng = random.Random(per_task)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, x) for x in range(5001, 5040)]
    edges += [(None, 3), (4, None), (9, 9)] + edges[:10]
    rng.shuffle(edges)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), edges_per_task=per_task).collect()}
    want = {k: v for k, v in components(edges).items() if Counter(components(edges).values())[v] > 1}
    assert got == want


def tied(trials, aliases):
    edges = [(("u", u), ("s", s)) for s, u in trials if s is not None and u is not None] + [(("u", a), ("u", b)) for a, b in aliases if a is not None and b is not None]
    c = components(edges + [(("s", s), ("s", s)) for s, _ in trials if s is not None])
    first = defaultdict(list)
    for s, _ in trials:
        if s is not None:
            first[c[("s", s)]].append(s)
    return {s: min(first[c[("s", s)]]) for s, _ in trials if s is not None}


def frames(spark, trials, aliases):
    return spark.createDataFrame([(*t, "c", "c") for t in trials], TRIALS), spark.createDataFrame([(*a, "c") for a in aliases], ALIASES)


def test_ties(spark):
    rng = random.Random(1)
    trials = [(rng.randint(1, 90), rng.choice([None, *range(30)])) for _ in range(120)] + [(None, 3), (500, None)]
    aliases = [(rng.randrange(40), rng.choice([None, *range(40)])) for _ in range(12)] + [(None, 1), (2, 2)]
    got = {r.seq_id: r.first_seq_id for r in tied_groups(*frames(spark, trials + trials[:9], aliases + aliases)).collect()}
    assert got == tied(trials, aliases)


def test_quotas_follow_the_greedy_rule():
    def plain(classes, shares):
        total = sum(s * n for s, n in classes)
        lack = {k: total * v for k, v in shares.items()}
        out = {}
        for size, n in sorted(classes, reverse=True):
            c = Counter()
            for _ in range(n):
                k = min(lack, key=lambda x: (-lack[x], x))
                lack[k] -= size
                c[k] += 1
            out[size] = dict(c)
        return out

    rng = random.Random(0)
    shares = {"train": 0.5, "validation": 0.25, "test": 0.25}
    for classes in ([(5, 3), (2, 10), (1, 40)], [(64, 1), (1, 5000)], [(rng.randint(1, 30), rng.randint(1, 9)) for _ in range(1)], [(4, 2000), (1, 1)]):
        got = {s: dict(p) for s, p in greedy_quotas(classes, shares).items()}
        want = plain(classes, shares)
        assert {s: sum(p.values()) for s, p in got.items()} == {s: sum(p.values()) for s, p in want.items()}
        for s in want:
            assert all(abs(got[s].get(k, 0) - want[s].get(k, 0)) <= 1 for k in shares)


def test_splits_keep_groups_and_shares(spark):
    rng = random.Random(2)
    trials = [(i, 7 if rng.random() < 0.1 else rng.choice([None, *range(100, 260)])) for i in range(600)]
    shares = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, share double")
    rows = assign_splits(*frames(spark, trials, [(100, 101)]), shares, buckets=3).collect()
    assert sorted(r.seq_id for r in rows) == list(range(600))
    assert all(len({r.split_name for r in rows if r.first_seq_id == g}) == 1 for g in {r.first_seq_id for r in rows})
    n = Counter(r.split_name for r in rows)
    assert abs(n["train"] - 480) <= 2 and abs(n["test"] - 60) <= 2 and abs(n["validation"] - 60) <= 2


def test_splits_of_nothing_and_bad_shares(spark):
    shares = spark.createDataFrame([("train", 1.0)], "split_name string, share double")
    assert assign_splits(*frames(spark, [], []), shares).count() == 0
    assert tied_groups(*frames(spark, [], [(1, 2)])).count() == 0
    with pytest.raises(ValueError):
        assign_splits(*frames(spark, [(1, 1)], []), shares.where("share < 0"))


TOKENS = "token_pos bigint, doc_id bigint, word_id int, word_count double, term string"
DOCS = "doc_id bigint, doc_range array<bigint>, owner string"
VOCAB = "word_id int, term string, total string"


def test_terms_against_brute_force(spark):
    nan = float("nan")
    tokens = [(0, 1, 0, 2.0), (0, 1, 0, 2.0), (1, None, 1, 1.5), (2, 1, 2, nan), (3, 1, 2, None), (4, 1, 2, 0.0), (5, 1, 2, -3.0), (6, 1, 99, 4.0), (10, None, 2, 3.0), (11, 2, 3, 5.0), (12, 2, 0, 1.0), (500, None, 1, 7.0)]
    docs = [(1, [0, 10]), (2, [10, 2500]), (2, [10, 2500]), (3, [2500, 2500]), (None, [0, 99]), (4, None)]
    vocab = [(0, " Café\t"), (1, "CAFÉ"), (2, "b"), (2, "b"), (3, None), (None, "zzz")]
    df = TM.term_frequencies(spark.createDataFrame([(*t, "c") for t in tokens], TOKENS), spark.createDataFrame([(*x, "c") for x in docs], DOCS), spark.createDataFrame([(*v, "c") for v in vocab], VOCAB))
    assert {(r.term, r.total, r.n_docs, r.mark) for r in df.collect()} == {("café", 11.5, 2, "rare"), ("b", 3.0, 1, "rare")}


def test_terms_of_nothing(spark):
    empty = [spark.createDataFrame([], s) for s in (TOKENS, DOCS, VOCAB)]
    assert TM.term_frequencies(*empty).count() == 0


def test_signed_deltas_equal_a_recount(spark, tmp_path):
    rng = random.Random(3)
    schema = "doc_id bigint, term string, n bigint, total double"
    make = lambda n: [(rng.randrange(6), f"t{rng.randrange(9)}", 1, float(rng.randint(1, 4))) for _ in range(n)]
    state = TM.TermCounts(spark, str(tmp_path / "s"), parts=4)
    now: list = []
    for i in range(4):
        out, new = (rng.sample(now, len(now) // 3) if i < 3 else list(now)), make(25 if i < 3 else 0)
        for r in out:
            now.remove(r)
        now += new
        state.apply(added=spark.createDataFrame(new, schema), removed=spark.createDataFrame(out, schema))
        want = {t: (sum(r[3] for r in now if r[1] == t), len({r[0] for r in now if r[1] == t})) for t in {r[1] for r in now}}
        assert {r.term: (r.total, r.n_docs) for r in state.terms().collect()} == want
    again = TM.TermCounts(spark, str(tmp_path / "s"))
    assert again.parts == 4 and again.terms().count() == 0
    again.apply()
    again.drop()


PAIRS = "doc_id bigint, term string, n bigint, total double"


def files_of(folder):
    return {str(f.relative_to(folder)) for f in folder.rglob("*.parquet")}


def test_a_delta_is_appended_where_its_documents_are(spark, tmp_path):
    s = TM.TermCounts(spark, str(tmp_path / "s"), parts=8)
    s.apply(added=spark.createDataFrame([(d, f"t{i}", 1, 1.0) for i in range(5) for d in range(40)], PAIRS))
    before = files_of(tmp_path / "s")
    s.apply(added=spark.createDataFrame([(2, f"t{i}", 1, 1.0) for i in range(15)], PAIRS))
    new = files_of(tmp_path / "s") - before
    assert before <= files_of(tmp_path / "s")
    assert len({f.split("part=")[1].split("/")[0] for f in new if f.startswith("pairs")}) == 1


def test_a_failed_delta_leaves_the_old_state(spark, tmp_path, monkeypatch):
    state = TM.TermCounts(spark, str(tmp_path / "s"), parts=2)
    state.apply(added=spark.createDataFrame([(1, "a", 2, 2.0), (2, "a", 1, 1.0)], PAIRS))
    seen = lambda: {(r.term, r.total, r.n_docs) for r in TM.TermCounts(spark, str(tmp_path / "s")).terms().collect()}
    change = {"added": spark.createDataFrame([(3, "b", 1, 4.0)], PAIRS), "removed": spark.createDataFrame([(1, "a", 2, 2.0)], PAIRS)}
    for broken in ("_commit", "_write"):
        def fail(*_):
            raise OSError("lost")

        with monkeypatch.context() as m:
            m.setattr(TM.TermCounts, broken, fail)
            with pytest.raises(OSError):
                state.apply(**change)
        assert seen() == {("a", 3.0, 2)}
    (tmp_path / "s" / "new-2.json").write_text("{")  # written, not renamed
    TM.TermCounts(spark, str(tmp_path / "s")).apply(**change)
    assert seen() == {("a", 1.0, 1), ("b", 4.0, 1)}


def test_old_versions_are_summed_up_and_removed(spark, tmp_path):
    s = TM.TermCounts(spark, str(tmp_path / "s"), parts=2, compact_after=3, pairs_per_part=5)
    for k in range(5):
        s.apply(added=spark.createDataFrame([(k, f"t{i}", 1, 0.1) for i in range(4)], PAIRS))
    s.apply(removed=spark.createDataFrame([(k, "t0", 1, 0.1) for k in range(5)], PAIRS))
    assert {(r.term, r.total, r.n_docs) for r in s.terms().collect()} == {(f"t{i}", 0.5, 5) for i in range(1, 4)}
    assert len(list((tmp_path / "s").glob("pairs/version=*"))) <= 4 and len(list((tmp_path / "s").glob("manifest-*.json"))) == 2
    assert s.parts >= 4

def test_sum_of_squares_places_everything():
    rng = np.random.default_rng(0)
    for sizes in (rng.integers(1, 101, 500), np.full(40, 100), np.full(33, 50), np.array([1]), np.zeros(0, int)):
        where, fills = sum_of_squares(sizes, 100)
        assert len(where) == len(sizes) and (not len(fills) or fills.max() <= 100)
        assert np.array_equal(np.bincount(where, sizes, len(fills)).astype(int), fills)
    where, fills = sum_of_squares(rng.integers(1, 60, 4000), 100)
    assert len(fills) <= 1.02 * -(-fills.sum() // 100)


def plain_sum_of_squares(sizes, capacity):
    gaps = Counter()
    n = 0
    for s in sizes:
        def cost(g, s=s):
            c = Counter(gaps)
            if g != capacity:
                c[g] -= 1
            if g - s:
                c[g - s] += 1
            return sum(v * v for v in c.values())
        options = [g for g in sorted(gaps) if gaps[g] > 0 and g >= s] + [capacity]
        g = min(options, key=lambda g: (cost(g), g))
        if g == capacity:
            n += 1
        else:
            gaps[g] -= 1
        if g - s:
            gaps[g - s] += 1
    return n, +gaps


def test_sum_of_squares_follows_its_rule():
    rng = np.random.default_rng(5)
    for _ in range(5):
        sizes = rng.integers(1, 21, 60)
        _, fills = sum_of_squares(sizes, 20)
        n, gaps = plain_sum_of_squares(sizes.tolist(), 20)
        assert len(fills) == n and Counter((20 - fills[fills < 20]).tolist()) == gaps


def test_shards_are_packed_together(spark):
    rng = random.Random(0)
    items = [(f"i{k}", rng.randint(1, 50)) for k in range(300)]
    rows = pack(spark.createDataFrame(items, "item string, size bigint"), capacity=50, items_per_task=40).collect()
    fill, size = Counter(), dict(items)
    for r in rows:
        fill[r.window] += size[r.item]
    assert sorted(r.item for r in rows) == sorted(size) and max(fill.values()) <= 50
    one = pack(spark.createDataFrame(items, "item string, size bigint"), capacity=50).select("window").distinct().count()
    assert len(fill) <= 1.1 * one  # shards of 40 items are far too small, and still nearly as good as one


def test_windows(spark):
    texts = {1: "word " * 7000, 2: "short text", 3: None, 4: "", 5: "é" * 300, None: "no id"}
    docs = spark.createDataFrame([(k, v, "c", "c") for k, v in texts.items()] + [(2, "short text", "c", "c")], "doc_id bigint, text string, window string, item string")
    rows = pack_windows(docs, capacity=512).collect()
    enc = encoding(DEFAULT_TOKENIZER)
    by_doc, fill = Counter(), Counter()
    for r in rows:
        by_doc[r.doc_id] += r.n_tokens
        fill[r.window] += r.n_tokens
    assert by_doc == {k: len(enc.encode_ordinary(v)) * (2 if k == 2 else 1) for k, v in texts.items() if v}
    assert max(fill.values()) <= 512 and {r.doc_id for r in rows if r.piece} == {1}
    cuts = sorted((r.piece, r.first_token, r.n_tokens) for r in rows if r.doc_id == 1)
    assert all(c[1] == 512 * c[0] for c in cuts) and all(c[2] == 512 for c in cuts[:-1])
    assert pack_windows(docs.where("doc_id > 90")).count() == 0
    assert rows and F.col("x") is not None
