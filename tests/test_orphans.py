import random
from datetime import datetime, timedelta

from codeloom.streaming.orphans import OrphanState, update_orphans

T = datetime(2024, 1, 15)


def day(n):
    return None if n is None else T + timedelta(days=n)


def update(spark, state, refs, parents):
    r = spark.createDataFrame([(i, t, day(a), day(v), k) for i, t, a, v, k in refs], "ref_id long, target string, at timestamp, arrival timestamp, kind string")
    p = spark.createDataFrame([(s, n, day(a), day(b), day(v), "x") for s, n, a, b, v in parents], "source string, name string, start timestamp, end timestamp, arrival timestamp, kind string")
    return update_orphans(state, r, p, keep=("kind",))


def replay(spark, refs, parents):
    return update(spark, None, refs, parents)


def opened(state):
    return {(r.month - state.first, r.reason): r.n_open for r in state.counts().collect()}


def test_reasons_and_edges(spark):
    refs = [
        (1, "a", 5, 5, "k"), (2, "a", 0, 1, "k"), (3, "a", 9, 9, "k"), (4, "a", 10, 10, "k"), (5, "nowhere", 5, 5, "k"), (6, None, 5, 5, None), (None, "a", 5, 5, "k"),
        (7, "b", 5, 5, "k"), (7, "b", 5, 5, "k"), (8, "c", None, 5, "k"), (9, "both", 5, 5, "k"), (10, "a", 1, 1, "k"),
    ]
    parents = [("s", "a", 1, 10, 0), ("s", "b", 20, None, 3), ("s", "c", None, None, 3), ("s", None, 0, 1, 1), ("s", "both", 8, None, 1), ("e", "both", 0, 6, None)]
    log = replay(spark, refs, parents)
    assert {(r.ref_id, r.reason) for r in log.current().collect()} == {(2, "late"), (4, "deleted"), (5, "missing"), (6, "missing"), (7, "late")}


def test_state_changes_over_periods(spark):
    # Waits for its parent, resolved when it arrives, reopened by a correction that ends its life earlier.
    refs = [(1, "p", 5, 5, "k"), (2, "q", 5, 5, "k")]
    parents = [("s", "p", 0, None, 40), ("s", "p", 0, 2, 60)]
    log = replay(spark, refs, parents)
    states = [{r.ref_id: r.reason for r in log.open_at(p).collect()} for p in range(log.first, log.last + 1)]
    assert [s.get(1) for s in states] == ["missing", None, "deleted"]
    assert all(s[2] == "missing" for s in states)
    assert opened(log) == {(0, "missing"): 2, (1, "missing"): 1, (2, "missing"): 1, (2, "deleted"): 1}


def test_empty(spark):
    assert replay(spark, [], []).current().count() == 0
    assert replay(spark, [], [("s", "a", 0, 1, 0)]).current().count() == 0
    assert [tuple(r) for r in replay(spark, [(1, "a", 0, 0, None)], []).current().collect()] == [(1, "missing")]


def test_against_brute_force_with_a_hot_target(spark):
    rng = random.Random(5)
    parents = [("s", f"n{rng.randrange(30)}", rng.randrange(100), rng.choice([None, rng.randrange(50, 300)]), 200 * rng.random()) for _ in range(60)]
    refs = [(i, "n0" if i % 3 == 0 else f"n{rng.randrange(40)}", rng.randrange(250), rng.randrange(300), "k") for i in range(4000)]
    latest = {}
    for s, n, a, b, v in parents:
        if n not in latest or (v, a) > latest[n][:2]:
            latest[n] = (v, a, b)
    want = set()
    for i, n, at, _, _ in refs:
        if n not in latest:
            want.add((i, "missing"))
        else:
            _, a, b = latest[n]
            if not (at >= a and (b is None or at < b)):
                want.add((i, "deleted" if b is not None and at >= b else "late"))
    got = {(r.ref_id, r.reason) for r in replay(spark, refs, parents).current().collect()}
    assert got == want


def test_months_are_kept_on_a_long_history(spark):
    # 30 months: opened in month 20, resolved in 21, ended by a correction in 23, and one that waits from month 2 on.
    refs = [(1, "p", 610, 610, "k"), (2, "q", 60, 60, "k"), (3, "r", 0, 0, "k")]
    parents = [("s", "p", 600, None, 640), ("s", "p", 600, 605, 700), ("s", "r", 0, None, 885), ("e", "r", 500, None, 0)]
    log = replay(spark, refs, parents)
    assert log.last - log.first == 29
    counts = opened(log)
    want = {(m, "missing"): 1 for m in range(2, 30)} | {(20, "missing"): 2} | {(m, "late"): 1 for m in range(29)} | {(m, "deleted"): 1 for m in range(23, 30)}
    assert counts == want


def test_updates_over_time_leave_the_log_of_one(spark, tmp_path):
    rng = random.Random(9)
    parents = [(rng.choice("se"), f"n{rng.randrange(30)}", rng.randrange(400), rng.choice([None, rng.randrange(200, 500)]), rng.choice([None, rng.randrange(400)])) for _ in range(150)]
    refs = [(i, "n0" if i % 3 == 0 else f"n{rng.randrange(40)}", rng.randrange(400), rng.randrange(400), "k") for i in range(2500)]

    def month(n):
        return 0 if n is None else day(n).year * 12 + day(n).month - T.year * 12 - T.month

    def reason(i, p):
        _, n, at, _, _ = refs[i]
        lives = {}
        for s, name, a, b, v in parents:
            if name == n and month(v) <= p:
                lives[s] = max(lives.get(s, ()), ((-1 if v is None else v), a, (-1 if b is None else b)))
        if not lives:
            return "missing"
        if any(at >= a and (b < 0 or at < b) for _, a, b in lives.values()):
            return None
        return "deleted" if any(0 <= b <= at for _, _, b in lives.values()) else "late"

    want = {}
    for i in range(len(refs)):
        for p in range(month(refs[i][3]), month(399) + 1):
            r = reason(i, p)
            if r:
                want[p, r] = want.get((p, r), 0) + 1
    whole = replay(spark, refs, parents)
    assert opened(whole) == want
    # The same feeds in four runs, each from the state that the one before saved.
    state = None
    for n, (lo, hi) in enumerate(((-1, 3), (3, 7), (7, 8), (8, 99))):
        part = [r for r in refs if lo < month(r[3]) <= hi], [p for p in parents if lo < month(p[4]) <= hi]
        state = update(spark, state, *part)
        state.save(f"{tmp_path}/{n}")
        state = OrphanState.load(spark, f"{tmp_path}/{n}")
    one, many = [sorted((r.ref_id, r.month, r.reason or "") for r in s.verdicts.collect()) for s in (whole, state)]
    assert one == many and (whole.first, whole.last) == (state.first, state.last)
    assert opened(state) == want
    # Nothing new changes nothing; what comes late belongs to the last month.
    again = update(spark, state, [], [])
    assert sorted((r.ref_id, r.month, r.reason or "") for r in again.verdicts.collect()) == many
    late = update(spark, state, [(10**6, "n-none", 0, 0, "k"), refs[0]], [("s", "n-other", 0, None, 0)])
    assert {(r.ref_id, r.month, r.reason) for r in late.verdicts.collect()} - {(r.ref_id, r.month, r.reason) for r in state.verdicts.collect()} == {(10**6, state.last, "missing")}
