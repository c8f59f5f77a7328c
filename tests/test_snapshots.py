import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from codeloom.functions.cleaning import hex_digest, relative_path
from codeloom.operators.snapshots import snapshot_changes

T = datetime(2024, 1, 1)


def changes(spark, rows, snaps, **extra):
    records = spark.createDataFrame(rows, "scope string, snap int, key string, digest string, at timestamp, seq string, k1 long")
    snapshots = spark.createDataFrame(snaps, "scope string, snapshot int")
    out = snapshot_changes(
        records, snapshots, scope=F.col("scope"), snapshot=F.col("snap"), key=F.col("key"), digest=F.col("digest"), version=F.col("at"), **extra
    )
    return sorted(tuple(r) for r in out.select("scope", "key", "snapshot", "change").collect())


def test_differences_nulls_ties_and_clashing_columns(spark):
    rows = [
        ("r", 1, "a", "01", T, "x", 1), ("r", 1, "b", "02", T, "x", 1), ("r", 1, "c", None, T, None, None),
        ("r", 2, "zz", "09", T, "x", 1),  # partial delivery, not listed
        ("r", 3, "a", "01", T, "x", 1), ("r", 3, "c", "05", T, "x", 1), ("r", 3, "d", "06", T, "x", 1),
        ("r", 4, "a", "0a", datetime(2024, 2, 1), "x", 1), ("r", 4, "a", "01", T, "x", 1),  # the later row holds
        ("r", 4, "c", "05", T, "x", 1), ("r", 4, "c", "05", T, "x", 1), ("r", 4, "d", "06", None, "x", 1),
        (None, 1, "a", "01", T, "x", 1), ("r", None, "a", "01", T, "x", 1), ("r", 3, None, "01", T, "x", 1),
        ("s", 1, "a", "01", T, "x", 1),
    ]
    got = changes(spark, rows, [("r", 1), ("r", 3), ("r", 4), ("s", 1), ("s", 1), (None, 2)])
    assert got == [("r", "a", 4, "changed"), ("r", "b", 3, "removed"), ("r", "d", 3, "added")]


def test_empty_tables(spark):
    assert changes(spark, [], [("r", 1)]) == []
    assert changes(spark, [("r", 1, "a", "01", T, None, None)], []) == []


def test_against_brute_force_with_a_hot_key(spark):
    rng = random.Random(3)
    rows, snaps, truth = [], [], {}
    for scope in "xy":
        for s in range(1, 6):
            listing = {f"k{i}": rng.choice(["01", "02", None]) for i in range(40) if rng.random() < 0.7}
            truth[scope, s] = listing
            snaps.append((scope, s))
            rows += [(scope, s, k, d, T, None, None) for k, d in listing.items()]
    truth["x", 1]["hot"] = "0f"
    rows += [("x", 1, "hot", "0f", T, None, None)] * 400
    want = []
    for scope in "xy":
        for s in range(2, 6):
            a, b = truth[scope, s - 1], truth[scope, s]
            want += [(scope, k, s, "added") for k in b.keys() - a.keys()] + [(scope, k, s, "removed") for k in a.keys() - b.keys()]
            want += [(scope, k, s, "changed") for k in a.keys() & b.keys() if a[k] and b[k] and a[k] != b[k]]
    assert changes(spark, rows, snaps, rows_per_bucket=30) == sorted(want)


@pytest.mark.parametrize(
    ("raw", "clean"),
    [(" ./a//b.py\n", "a/b.py"), ("a\\b\\c.h", "a/b/c.h"), ("/x/./y", "x/y"), ("  ", None), ("././a", "a"), (".github/x", ".github/x")],
)
def test_relative_path(spark, raw, clean):
    assert spark.createDataFrame([(raw,)], "p string").select(relative_path(F.col("p"))).first()[0] == clean


def test_hex_digest(spark):
    rows = [("ABCD01",), ("sha256:abcd01",), ("SHA256:ABCD01 ",), ("",), (None,), ("not a hash",)]
    got = [r[0] for r in spark.createDataFrame(rows, "h string").select(hex_digest(F.col("h"))).collect()]
    assert got == ["abcd01", "abcd01", "abcd01", None, None, None]
