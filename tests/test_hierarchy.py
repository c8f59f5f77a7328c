import random

import pytest

from codeloom.operators.hierarchy import build_hierarchy, descendants


def brute(parents):
    out = {}
    for x in parents:
        path, seen, y = [], {}, x
        while True:
            if y is None:
                out[x] = ("rooted", path[-1], len(path) - 1, path[::-1])
                break
            if y not in parents:
                out[x] = ("broken", y, len(path), [y, *path[::-1]])
                break
            if y in seen:
                cycle = path[seen[y] :]
                steps = 0 if x in cycle else next(i for i, z in enumerate(path) if z in cycle)
                out[x] = ("on_cycle" if x in cycle else "below_cycle", min(cycle), steps, None)
                break
            seen[y] = len(path)
            path.append(y)
            y = parents[y]
    return out


def solve(spark, pairs, paths=True):
    links = spark.createDataFrame([(a, b, "x", 1) for a, b in pairs], "name string, parent string, status string, id int")
    return build_hierarchy(links, paths=paths)


def compare(spark, parents, paths=True):
    got = {r["name"]: (r["status"], r["top"], r["steps"], r["path"] if paths else None) for r in solve(spark, list(parents.items()), paths).collect()}
    want = {k: v if paths else (*v[:3], None) for k, v in brute(parents).items()}
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(120)]
    parents = {n: rng.choice([None, "gone", f"lost{rng.randrange(3)}", *names]) if rng.random() < 0.3 else names[rng.randrange(max(1, i))] for i, n in enumerate(names)}
    compare(spark, parents, paths=seed == 1)


def test_chains_stars_cycles_and_self_loops(spark):
    parents = {f"c{i}": f"c{i - 1}" if i else None for i in range(70)}
    parents |= {f"s{i}": "c3" for i in range(50)}
    parents |= {"x1": "x2", "x2": "x3", "x3": "x1", "y": "x2", "z": "y", "self": "self", "p": "q", "q": "p", "below": "self", "r": None}
    compare(spark, parents)
    tree = solve(spark, list(parents.items()))
    pairs = {(r["ancestor"], r["descendant"]): r["distance"] for r in descendants(tree).collect()}
    assert pairs["c0", "s7"] == 4 and pairs["c3", "c4"] == 1 and ("x1", "x2") not in pairs


def test_nulls_repeats_and_empty(spark):
    assert solve(spark, []).count() == 0
    rows = [("a", None), ("a", None), ("b", "a"), ("b", None), (None, "a"), ("c", "missing")]
    got = {r["name"]: (r["status"], r["top"], r["steps"]) for r in solve(spark, rows, False).collect()}
    assert got == {"a": ("rooted", "a", 0), "b": ("rooted", "a", 1), "c": ("broken", "missing", 1)}
