import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from codeloom.llm.packing import closest_fill, pack_windows, plan_windows, token_count, window_report


def run(spark, sizes, budgets):
    s = spark.createDataFrame(sizes, "doc_id long, tokens int, capacity string, rank int")
    b = spark.createDataFrame(budgets, "budget_name string, capacity int")
    return pack_windows(s, b, rows_per_bucket=50)


@pytest.mark.parametrize("seed", range(5))
def test_closest_fill_is_optimal(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(3, 25): rng.randrange(1, 4) for _ in range(5)}
    target = rng.randrange(10, 70)
    used = closest_fill(counts, sorted(counts, reverse=True), target)
    assert all(n <= counts[k] for k, n in used.items())
    best = max(t for c in product(*[range(v + 1) for v in counts.values()]) if (t := sum(k * n for k, n in zip(counts, c))) <= target)
    assert sum(k * n for k, n in used.items()) == best


def test_plan_uses_every_piece_once():
    rng = random.Random(2)
    counts = {k: rng.randrange(1, 9) for k in rng.sample(range(1, 200), 90)}
    left = dict(counts)
    for used, times in plan_windows(counts, 200):
        assert sum(k * n for k, n in used.items()) <= 200
        for k, n in used.items():
            left[k] -= n * times
    assert not any(left.values())


def test_windows_hold_every_document(spark):
    rng = random.Random(4)
    sizes = [(i, rng.choice([0, 7, 100, 64, 65, 128, 129, 640, rng.randrange(1, 60)]), "x", 1) for i in range(400)]
    sizes += [(5, 9, "x", 1), (None, 12, None, None), (999, None, None, None), (1000, 100_000, None, None)]
    budgets = [("a", 64), ("b", 128), ("b", 128), ("c", 0), (None, 8)]
    out = run(spark, sizes, budgets)
    rows = out.collect()
    for name, capacity in (("a", 64), ("b", 128)):
        own = [r for r in rows if r["budget_name"] == name]
        fill = {}
        for r in own:
            fill[r["window_id"]] = fill.get(r["window_id"], 0) + r["tokens"]
        assert max(fill.values()) <= capacity
        assert set(fill) == set(range(len(fill)))
        total = {}
        for r in own:
            total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["tokens"]
        want = {}
        for d, t, *_ in sizes:
            want[d] = want.get(d, 0) + (t or 0)
        assert total == want
        cut = [r["doc_id"] for r in own if r["part"] > 0]
        assert all(want[d] > capacity for d in cut)
        assert len(own) == sum(max(1, -(-(t or 0) // capacity)) for _, t, *_ in sizes)
    report = {r["budget_name"]: r for r in window_report(out).collect()}
    assert report["a"]["filled"] > 0.98 and report["a"]["n_windows"] >= report["a"]["least_windows"]


def test_hot_length_and_empty(spark):
    out = run(spark, [(i, 30, "x", 1) for i in range(301)], [("a", 64)]).collect()
    assert len({r["window_id"] for r in out}) == 151
    assert run(spark, [], [("a", 64)]).count() == 0
    assert run(spark, [(1, 5, "x", 1)], []).count() == 0
    assert [(r["window_id"], r["tokens"]) for r in run(spark, [(1, 0, "x", 1)], [("a", 64)]).collect()] == [(0, 0)]


def test_token_count(spark):
    rows = [("a_1 + 22;", 4), ("x\u2003y\u00a0z", 3), ("café", 2), ("", 0), (None, None)]
    got = spark.createDataFrame(rows, "t string, n int").withColumn("got", token_count(F.col("t"))).collect()
    assert all(r["got"] == r["n"] for r in got)
