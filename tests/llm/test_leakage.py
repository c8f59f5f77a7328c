import html
import random

import numpy as np

from codeloom.llm.leakage import ItemIndex, candidates, leaked_items, most_within
from codeloom.llm.words import words

RNG = random.Random(11)
VOCABULARY = [f"{a}{b}" for a in "ka lo mi nu pe ra si to vu we".split() for b in "dar fen gil hok jum lat mop nez pik rus".split()]


def passage(n):
    return [RNG.choice(VOCABULARY) for _ in range(n)]


def run(spark, docs, items, **extra):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string, words string")
    i = spark.createDataFrame(items, "item_id long, text string, shingle int")
    return {tuple(r) for r in leaked_items(d, i, **extra).collect()}


def test_forms_and_thresholds(spark):
    items = [passage(60) for _ in range(12)]
    a = items[0]
    docs = {
        1: " ".join(a),
        2: " ".join(passage(50) + a[:33] + passage(50)),  # over half
        3: " ".join(passage(50) + a[:18] + passage(50)),  # under a third: not found
        4: " ".join(a[10:27] + passage(25) + a[27:45]),  # two places close to each other
        5: "\n".join("// " + " ".join(a[i : i + 7]).upper() + "," for i in range(0, 60, 7)),
        6: html.escape("<p>" + " &nbsp; ".join(a) + "</p>").replace(" ", "  "),
        7: " ".join(w if i % 9 else "changed" for i, w in enumerate(a)),
        8: " ".join(reversed(a)),  # not in order
        9: " ".join(a).replace("a", "а").replace("o", "ο"),  # look-alike letters
        10: '{"body": "' + "\\n".join(a) + '"}',
        11: " ".join(passage(2000) + a + passage(2000)),
        12: "",
        13: "   ",
        14: " ".join(w[:2] + "\u200b" + w[2:] for w in a),
        15: " ".join(passage(400)),
    }
    rows = [(k, v, "x", None) for k, v in docs.items()] + [(16, None, None, None), (None, docs[1], None, None), (1, docs[1], None, None)]
    texts = [(i, " ".join(t), 1) for i, t in enumerate(items)] + [(90, None, 1), (91, " ", 1), (92, "kadar", 1), (None, "x y z", 1)]
    want = {(k, 0) for k in (1, 2, 4, 5, 6, 7, 9, 10, 11, 14)}
    got = run(spark, rows, texts)
    assert {x for x in got if x[1] != 92} == want
    assert got == run(spark, rows, texts, words_per_block=200)


def test_changed_words_and_short_items(spark):
    a = passage(80)
    items = [(1, " ".join(a), 1), (2, "red brown fox", 1), (3, "one of four words seven times", 1), (4, "solo", 1), (5, "two words", 1), (6, " ".join(passage(10)), 1), (7, "...", 1)]
    docs = {
        1: " ".join(w if i % 4 else f"new{i}" for i, w in enumerate(a)),  # every fourth word changed
        2: " ".join(w if i % 2 else f"new{i}" for i, w in enumerate(a[:40])),  # a quarter, in single words
        3: "A Red, brown FOX!",
        4: "the red one and the brown other fox",  # three words in order, close to each other
        5: "fox brown red",
        6: "one of four",
        7: "solo",
        8: "xx " * 9 + "words",
        9: " ".join(passage(3) + items[5][1].split()[:5] + passage(3)),
        10: " ".join(a[:21] + passage(20) + a[60:]),  # half, in two places
        11: " ".join(a[:20] + passage(400) + a[60:]),  # too far apart
    }
    got = run(spark, [(k, v, None, None) for k, v in docs.items()], items)
    assert got == {(1, 1), (3, 2), (4, 2), (6, 3), (7, 4), (8, 5), (9, 6), (10, 1)}


def test_prefix_and_bounds_lose_nothing():
    # Against all pairs that share enough shingles in a window, whatever their rarity.
    rng = random.Random(4)
    pool = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice((4, 8, 15, 40))))) for i in range(25)]
    texts = [" ".join(rng.choice(pool) for _ in range(100)) + " " + " ".join(t.split()[: rng.randrange(3, 40)]) for _ in range(12) for _, t in items]
    index = ItemIndex(items)
    x, begin = index.read(texts)
    at, what = index.hits(x)
    index.order(np.bincount(what, minlength=index.n_shingles))
    got = {(d, k) for d, k, _ in candidates(index, x, begin)}
    want = set()
    for d in range(len(texts)):
        here = (at >= begin[d]) & (at < begin[d + 1])
        for k, own in enumerate(index.of_item):
            mine = here & np.isin(what, own)
            place, which = at[mine], what[mine]
            if any(len(set(which[(place >= p) & (place <= p + index.width[k])].tolist())) >= index.need[k] for p in place):
                want.add((d, k))
    assert got == want and len(want) > 100
    assert most_within(np.array([0, 5, 10, 40]), np.array([1, 1, 2, 3]), 10) == 2


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b c d e f", 1)]) == set()
    assert run(spark, [(1, "a b c", None, None)], []) == set()


def test_words():
    assert words("It&#39;s \\u0041bc, na\u00efve &lt;b&gt;x&lt;/b&gt; re-\n use ﬁne") == ["it", "s", "abc", "naive", "x", "reuse", "fine"]
    assert words("") == []
