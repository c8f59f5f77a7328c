import random

import numpy as np

from codeloom.llm import quality
from codeloom.llm.quality import LABELS, STATISTICS, document_statistics, fit_mixture, label_documents, labelled_majority, not_prose, text_statistics

PROSE = "The parser reads the file and it is then checked by the reader, which reports what was found in the text.\n"
LIST = "- alpha module\n- beta module\n- gamma module\n"
TABLE = "| 1 | 2 | 3 |\n| 4 | 5 | 6 |\n"


def junk(rng):
    return "".join(rng.choice("ABCDEFabcdef0123456789+/") for _ in range(400))


def make(rng):
    docs, labels = [], []
    for i in range(240):
        kind = LABELS[i % 4]
        text = {"prose": PROSE * 1 + "".join(f"We saw that the item {rng.randrange(999)} of the list was in the {rng.choice('abcdef')} part.\n" for _ in range(6)),
                "list": "".join(f"- {rng.choice('abcdef') * 5} module{rng.randrange(999)}\n" for _ in range(30)),
                "table": "".join(f"| {rng.randrange(999)} | {rng.random():.3f} | {rng.randrange(99)} |\n" for _ in range(20)), "junk": junk(rng)}[kind]
        docs.append((i, text, ("en", "de", "es")[i % 3], "x", None))
        if i % 3 == 0:
            labels.append((i, kind.upper() if i % 2 else f" {kind} ", "ann"))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, label string, n_visible int"), spark.createDataFrame(labels, "doc_id long, label string, prose_share string")


def test_labels_follow_the_examples(spark):
    docs, labels = make(random.Random(1))
    docs += [(900, None, "en", None, None), (901, " \n", "de", None, None), (902, LIST * 50, "python", None, None), (903, PROSE, None, None, None), (904, PROSE * 40, "en", None, None), (None, LIST * 9, "en", None, None), (1, docs[1][1], "de", None, None)]
    docs += [(i, f"We saw that the item {i} was in the {'very ' * (i - 904)}last part of the list and it is as it was.\n" * 40, "en", None, None) for i in range(905, 912)]
    labels += [(i, "junk", "ann") for i in (905, 908, 911)]
    d, l = frames(spark, docs, labels)
    found = {r["doc_id"] for r in not_prose(d, l).collect()}
    assert found == {i for i in range(240) if i % 4} | {900, 901} | set(range(904, 912))  # these repeat a line without end
    got = {r["doc_id"]: r["label"] for r in label_documents(d, l).collect() if r["doc_id"] is not None and r["doc_id"] < 240}
    assert sum(got[i] == LABELS[i % 4] for i in got) / len(got) > 0.95


def test_no_documents_or_no_labels(spark):
    d, l = frames(spark, [], [])
    assert not_prose(d, l).count() == 0
    d, l = frames(spark, [(1, PROSE, "en", None, None), (2, "", "en", None, None)], [(1, None, None), (None, "prose", None)])
    assert {r["doc_id"] for r in not_prose(d, l).collect()} == {2}


def test_mixture_improves_likelihood(spark):
    docs, labels = make(random.Random(2))
    d, l = frames(spark, docs, labels)
    stats = document_statistics(d).cache()
    x = stats.toPandas()[list(quality.MIXED)].to_numpy(float)
    like = [fit_mixture(stats, labelled_majority(l), steps=s).posteriors(x)[1].sum() for s in (1, 6)]
    assert like[1] >= like[0] and np.isfinite(like).all()


def test_majority_and_statistics(spark):
    rows = [(1, "Prose", ""), (1, "list", ""), (1, " prose", ""), (2, "table", ""), (2, "junk", ""), (3, None, "")]
    got = {r["doc_id"]: r["label"] for r in labelled_majority(spark.createDataFrame(rows, "doc_id long, label string, n string")).collect()}
    assert got == {1: "prose", 2: "junk"}
    assert text_statistics("")[0] == 0
    visible, *values = text_statistics(PROSE + LIST)
    named = dict(zip(STATISTICS, values))
    assert visible > 0 and 0 < named["prose_share"] < 1 and named["list_share"] > 0.2
    assert text_statistics("word " * 2_000_000)[0] == 8_000_000


def test_only_a_closed_fence_is_code():
    def clutter(text):
        return dict(zip(STATISTICS, text_statistics(text)[1:]))["clutter_share"]

    noise = "".join(f"x{i}==#{i * 7}\n" for i in range(40))
    assert clutter(f"{PROSE}```\n{noise}```\n{PROSE}") < 0.1
    assert clutter(f"{PROSE}```\n{noise}") > 0.5
    assert clutter(f"{PROSE}```\nrun\n```\n  ```\n{noise}") > 0.5


def test_the_label_alone_decides(spark, monkeypatch):
    rows = [(1, "en", 9, "prose", 0.7), (2, "en", 9, "junk", 0.3), (3, "en", 9, "table", 0.3), (4, "en", 0, "junk", 0.0), (None, "en", 9, "junk", 0.0), (2, "de", 9, "prose", 0.9)]
    labelled = spark.createDataFrame(rows, "doc_id long, lang string, n_visible long, label string, p_prose double")
    monkeypatch.setattr(quality, "label_documents", lambda *_: labelled)
    assert [r["doc_id"] for r in not_prose(None, None).orderBy("doc_id").collect()] == [2, 3, 4]


def test_the_mixture_finds_what_a_threshold_would_not(spark):
    # Generated sentences of common words with the statistics of no prose: the examples call them junk, the clutter is nil.
    rng = random.Random(3)
    docs, labels = make(rng)
    for i in range(300, 360):
        text = "".join(f"it is {rng.choice(('as', 'of', 'to'))} the {rng.choice(('on', 'in', 'at'))} {rng.randrange(10**15, 10**16)} and {rng.randrange(10**15, 10**16)} {rng.randrange(99)}\n" for _ in range(20))
        docs.append((i, text, "en", "x", None))
        labels.append((i, "junk", "ann")) if i % 2 else None
    d, l = frames(spark, docs, labels)
    assert {r["doc_id"] for r in not_prose(d, l).collect()} >= set(range(300, 360))
    assert all(dict(zip(STATISTICS, text_statistics(t)[1:]))["clutter_share"] < 0.5 for i, t, *_ in docs if i >= 300)
