import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from mixloom.operators import orphans as O

T0 = datetime(2024, 1, 1)
META = "seq_id bigint, arrived_at timestamp, deleted_at timestamp, key string"
REFS = "seq_id bigint, at timestamp, key string, period int"


def found(spark, refs, meta, **kw):
    r = O.Reference("t", spark.createDataFrame(refs, REFS), F.col("seq_id"), F.col("at"))
    return {tuple(x) for x in O.orphan_references([r], spark.createDataFrame(meta, META), **kw).collect()}


def brute(refs, meta):
    out = set()
    for s, t, *_ in refs:
        if s is None:
            continue
        own = [(a, d) for k, a, d, _ in meta if k == s]
        if t is None:
            if not own:
                out.add(("t", None, s, "missing"))
            continue
        if any(a is not None and a <= t and (d is None or t < d) for a, d in own):
            continue
        late = own and all(a is not None and a > t for a, _ in own)
        out.add(("t", t.strftime("%Y-%m"), s, "missing" if not own else "late" if late else "deleted"))
    return out


def test_random_cases_against_brute_force(spark):
    rng = random.Random(5)
    for n_meta in (0, 25, 60):
        day = lambda: T0 + timedelta(days=rng.randint(0, 400), hours=rng.randint(0, 5))  # noqa: E731, B023
        meta = [(rng.randint(1, 20), day(), rng.choice([None, day()]), "x") for _ in range(n_meta)]
        refs = [(rng.choice([None, *range(1, 26)]), rng.choice([None, day(), day(), day()]), "x", 1) for _ in range(300)]
        refs += refs[:20]  # repeated rows
        assert found(spark, refs, meta) == brute(refs, meta)
        assert found(spark, refs, meta, max_words=1) == brute(refs, meta)  # a full filter changes nothing


def test_edges_of_a_life(spark):
    meta = [(1, T0, T0 + timedelta(days=5), "a"), (1, T0 + timedelta(days=5), T0 + timedelta(days=7), "a"), (2, T0, None, "a"), (3, T0, T0, "a"), (4, None, None, "a")]
    refs = [(1, T0, "", 0), (1, T0 + timedelta(days=5), "", 0), (1, T0 + timedelta(days=40), "", 0), (2, T0 - timedelta(seconds=1), "", 0), (3, T0, "", 0), (4, T0, "", 0), (9, T0, "", 0), (None, T0, "", 0)]
    assert found(spark, refs, meta) == {("t", "2024-02", 1, "deleted"), ("t", "2023-12", 2, "late"), ("t", "2024-01", 3, "deleted"), ("t", "2024-01", 4, "deleted"), ("t", "2024-01", 9, "missing")}


def test_gap_between_first_and_last_row_of_a_month(spark):
    meta = [(1, T0, T0 + timedelta(days=3), ""), (1, T0 + timedelta(days=9), None, "")]
    refs = [(1, T0 + timedelta(days=d), "", 0) for d in (1, 5, 12)]
    assert found(spark, refs, meta) == {("t", "2024-01", 1, "deleted")}


def test_empty_tables(spark):
    assert found(spark, [], [(1, T0, None, "")]) == set()
    assert found(spark, [(1, T0, "", 0)], []) == {("t", "2024-01", 1, "missing")}


def test_written_numbers(spark):
    cases = {"1,445": 1445, "SEQ-2953": 2953, "\t00213": 213, "#777": 777, "5,002,690": 5002690, "n/a": None, "": None, None: None, "１２": 12, "378.0": 378, "1 063": 1063, "9" * 25: None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.n for r in df.select("t", O.written_number(F.col("t")).alias("n")).collect()} == cases


def test_bloom_filter_has_no_false_negatives(spark):
    keys = spark.range(5000).select((F.col("id") * 7).alias("k"))
    words, n = O.bloom_words(keys, "k")
    tested = O.with_bloom_test(keys, "k", words, n)
    assert tested.where("NOT maybe_parent").count() == 0
    others = O.with_bloom_test(spark.range(5000).select((F.col("id") * 7 + 1).alias("k")), "k", words, n)
    assert others.where("maybe_parent").count() < 600
