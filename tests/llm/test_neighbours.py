import numpy as np
import pytest

from codeloom.llm.neighbours import Index, _cut, kmeans, list_count, nearest_neighbours, similar_pairs


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, model_id string, vector array<float>, rep string, size int")


def brute(rows, k):
    out = {}
    usable = [(i, m, np.array(v, np.float64)) for i, m, v in rows if v is not None and len(v) == 64 and None not in v and np.isfinite(v).all() and np.any(v) and m is not None]
    for m in {x[1] for x in usable}:
        own = sorted((i, v / np.linalg.norm(v)) for i, mm, v in usable if mm == m)
        ids, x = np.array([i for i, _ in own]), np.stack([v for _, v in own])
        s = np.round(x @ x.T, 9)
        np.fill_diagonal(s, -2)
        for a in range(len(ids)):
            order = np.argsort(-s[a], kind="stable")[:k]
            out[int(ids[a])] = [(int(ids[b]), s[a, b]) for b in order if s[a, b] > -1.5]
    return out


def make(seed=1, n=900):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 64))
    rows = []
    for i in range(n):
        c = centres[0] if i % 3 == 0 else centres[rng.integers(12)]
        rows.append((i, "m" if i % 7 else "n", (c + 0.25 * rng.normal(size=64)).astype(np.float32).tolist()))
    for i in range(0, 60, 2):
        rows[i + 1] = (i + 1, rows[i][1], (np.array(rows[i][2]) + 0.02 * rng.normal(size=64)).astype(np.float32).tolist())
    return rows


def test_recall_against_brute_force(spark):
    rows = make()
    got = {}
    for r in nearest_neighbours(frame(spark, [(*r, "x", 1) for r in rows]), 5, block=64).collect():
        got.setdefault(r["vec_id"], []).append(r["neighbour"])
    rows32 = [(i, m, np.array(v, np.float32)) for i, m, v in rows]
    want = brute([(i, m, v.tolist()) for i, m, v in rows32], 5)
    hit = sum(len({b for b, _ in want[q]} & set(got.get(q, []))) for q in want)
    assert hit / sum(len(v) for v in want.values()) >= 0.9
    assert all(len(v) == 5 for v in got.values())


def test_copies_ties_and_unusable_vectors(spark):
    v = np.eye(64, dtype=np.float32)
    rows = [(i, "m", v[0].tolist(), "x", 1) for i in range(1, 400)] + [(500, "m", (v[0] + 0.1 * v[1]).tolist(), "x", 1), (501, "m", v[5].tolist(), "x", 1), (502, "m", v[5].tolist(), "x", 1)]
    bad = [(600, "m", None, "x", 1), (601, "m", [], "x", 1), (602, "m", [1.0] * 32, "x", 1), (603, "m", [0.0] * 64, "x", 1), (604, "m", [float("nan")] * 64, "x", 1), (605, "m", [float("inf")] * 64, "x", 1), (606, None, v[0].tolist(), "x", 1), (None, "m", v[0].tolist(), "x", 1), (607, "alone", v[0].tolist(), "x", 1), (608, "m", [None] * 64, "x", 1)]
    near = nearest_neighbours(frame(spark, rows + bad), 5)
    got = {}
    for r in near.collect():
        got.setdefault(r["vec_id"], {})[r["rank"]] = r["neighbour"]
    assert [got[300][i] for i in range(1, 6)] == [1, 2, 3, 4, 5] and [got[2][i] for i in range(1, 6)] == [1, 3, 4, 5, 6]
    assert [got[500][i] for i in range(1, 6)] == [1, 2, 3, 4, 5] and got[501][1] == 502
    assert not set(got) & set(range(600, 609))
    pairs = {tuple(r) for r in similar_pairs(near).collect()}
    assert (1, 500) in pairs and (501, 502) in pairs and all(a < b for a, b in pairs)


def test_empty(spark):
    assert nearest_neighbours(frame(spark, []), 5).count() == 0


def test_index_parts():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = Index(kmeans(x, 10), np.zeros(10, int))
    lists = index.list_order(x, 3)
    assert (lists[:, 0] == ((x[:, None] - index.centroids) ** 2).sum(2).argmin(1)).all()
    r = x - index.centroids[lists[:, 0]]
    index.codebooks = np.stack([kmeans(r[:, s : s + 4], 256, rounds=6) for s in range(0, 64, 4)])
    codes = index.encode(x, lists[:, 0])
    approx = index.distances(x[:20], lists[:, 0], codes, index.offsets(lists[:, 0], codes))
    exact = ((x[:20, None] - x) ** 2).sum(2)
    assert np.corrcoef(approx.ravel(), exact.ravel())[0, 1] > 0.8
    # The table's sum is the distance to the coded vector.
    y = index.centroids[lists[:, 0]] + np.concatenate([b[codes[:, s]] for s, b in enumerate(index.codebooks)], axis=1)
    assert np.allclose(approx, ((x[:20, None] - y) ** 2).sum(2), atol=1e-4)
    assert kmeans(x, 700).shape == (500, 64)


def test_lists_grow_with_the_root_at_any_size():
    for n in (10**4, 10**6, 10**8, 10**10):
        assert n / list_count(n) == pytest.approx(np.sqrt(n) / 4, rel=0.01)
    assert list_count(1) == 1 and list_count(40) == 10


def test_units_are_bounded():
    index = Index(np.zeros((7, 64), np.float32), np.array([0, 0, 0, 1, 1, 1, 2]))
    _cut(index, np.array([30, 30, 50, 10, 250, 10, 0]), 100)
    assert index.unit_of.tolist() == [0, 0, 1, 2, 3, 4, 5]  # no unit over 100 but for one list
    assert index.blocks.tolist() == [1, 1, 1, 3, 1, 1]


def test_visits_are_calibrated(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 64))  # without any structure, so that neighbours lie in many lists
    rows = [(i, "m", v.astype(np.float32).tolist(), "x", 1) for i, v in enumerate(x)]
    df = frame(spark, rows)
    wide, narrow = [{(r["vec_id"], r["neighbour"]) for r in nearest_neighbours(df, 5, recall=r, train_rows=1000, calibration=100, rerank=200).collect()} for r in (0.97, 0.4)]
    want = {(q, b) for q, near in brute([r[:3] for r in rows], 5).items() for b, _ in near}
    share = [len(got & want) / len(want) for got in (wide, narrow)]
    assert share[0] > 0.93 and 0.3 < share[1] < 0.6


def test_floor_leaves_out_only_what_is_below(spark):
    df = frame(spark, [(*r, "x", 1) for r in make(3, 500)])
    whole = {(r["vec_id"], r["neighbour"]) for r in nearest_neighbours(df, 5).where("cosine >= 0.9").collect()}
    assert whole == {(r["vec_id"], r["neighbour"]) for r in nearest_neighbours(df, 5, floor=0.9).collect()} and whole


def test_repeated_ids(spark):
    v = np.eye(64, dtype=np.float32)
    rows = [(1, "m", v[0].tolist(), "x", 1), (1, "n", v[1].tolist(), "x", 1), (2, "m", v[0].tolist(), "x", 1), (3, "m", v[1].tolist(), "x", 1), (3, "m", v[1].tolist(), "x", 1)]
    got = {(r["vec_id"], r["neighbour"], r["rank"]) for r in nearest_neighbours(frame(spark, rows), 2).collect()}
    assert got == {(1, 2, 1), (1, 3, 2), (2, 1, 1), (2, 3, 2), (3, 1, 1), (3, 2, 2)}
