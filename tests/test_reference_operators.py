import math
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from codeloom.functions.text import base_name, code_tokens, preview, search_tokens
from codeloom.operators import context, dense, evaluation, graph, incremental, lexical, resolve
from codeloom.operators.fusion import fuse


def ranked(spark, items, query=1):
    return spark.createDataFrame([(query, x, i + 1) for i, x in enumerate(items)], "query_id long, item string, rank int")


def test_rrf_scores_and_ties(spark):
    got = {r["item"]: r["score"] for r in fuse([("l", ranked(spark, ["a", "b"])), ("d", ranked(spark, ["x", "a"]))]).collect()}
    assert got["a"] == pytest.approx(1 / 61 + 1 / 62, abs=1e-9) and got["b"] == pytest.approx(1 / 62, abs=1e-9)
    first = fuse([("l", ranked(spark, ["b", "a"])), ("d", ranked(spark, ["a", "b"]))], 1).collect()
    assert [r["item"] for r in first] == ["a"]
    for r in fuse([("l", ranked(spark, ["a", "b"])), ("d", ranked(spark, ["x", "a"]))]).collect():
        assert r["score"] == pytest.approx(sum(c["part"] for c in r["contributions"]), abs=1e-9)


def test_bm25_equals_sqlite_fts5(spark):
    texts = ["alpha beta gamma beta", "beta alpha", "Café normalize_email(x) alpha beta", "", "gamma gamma delta alpha", None, "the alpha_beta thing. beta"]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(a, b, tokenize='unicode61')")
    for i, x in enumerate(texts):
        db.execute("INSERT INTO t(rowid, a, b) VALUES (?, ?, ?)", (i, x or "", f"name{i} beta"))
    docs = spark.createDataFrame([(i, x, f"name{i} beta") for i, x in enumerate(texts)], "id long, a string, b string")
    queries = ["alpha", "alpha_beta gamma", "normalize_email", "cafe", "beta", "alpha alpha", "unknown", "  ", "delta ??"]
    frame = spark.createDataFrame(list(enumerate(queries)), "query_id long, text string")
    got = {(r["query_id"], r["id"]): r["score"] for r in lexical.lexical_search(frame, docs, "id", ["a", "b"], 20).collect()}
    want = {}
    for i, q in enumerate(queries):
        phrases = [f'"{c}"' for c in q.split() if re.search(r"\w", c)]
        if phrases:
            for rowid, score in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (" OR ".join(phrases),)):
                want[i, rowid] = -score
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=2e-6)


def test_tokens_previews_names(spark):
    rows = [("café", 2), ("123.45", 3), ("::", 2), ("\U0001f600", 1), ("  ", 0), (None, 0), ("a\x1cb", 2)]
    df = spark.createDataFrame(rows, "t string, n int")
    assert all(r["got"] == r["n"] for r in df.withColumn("got", code_tokens(F.col("t"))).collect())
    assert spark.range(1).select(search_tokens(F.lit("Normalize_Émail.x2 ß"))).first()[0] == ["normalize", "email", "x2", "ß"]
    assert spark.range(1).select(preview(F.lit("  a \t b\nc"))).first()[0] == "a b"
    long = spark.range(1).select(preview(F.lit("x" * 200))).first()[0]
    assert len(long) == 120 and long.endswith("...")
    assert spark.range(1).select(base_name(F.lit("a::B::f(std::string) const"))).first()[0] == "f"


EDGES = [("contains", "mod", "a", "a", "resolved"), ("calls", "a", "b", "b", "resolved"), ("calls", "b", "c", "c", "probable"), ("calls", "a", None, "zzz", "unresolved"), ("calls", "c", "gone", "gone", "resolved"), ("calls", "b", "a", "a", "resolved")]


@pytest.fixture()
def small(spark):
    edges = spark.createDataFrame(EDGES, "kind string, source string, target string, target_text string, resolution string")
    nodes = spark.createDataFrame([("mod",), ("a",), ("b",), ("c",), ("lone",)], "name string")
    return edges, nodes


def test_graph(spark, small):
    edges, nodes = small
    near = {(r["name"], r["neighbour"]) for r in graph.neighbours(edges, nodes, "outgoing").collect()}
    assert near == {("mod", "a"), ("a", "b"), ("b", "c"), ("b", "a")}
    seeds = spark.createDataFrame([("mod",), ("lone",)], "seed string")
    seen = {(r["seed"], r["name"]): r["distance"] for r in graph.reach(seeds, graph.neighbours(edges, nodes, "outgoing"), 5).collect()}
    assert seen == {("mod", "mod"): 0, ("mod", "a"): 1, ("mod", "b"): 2, ("mod", "c"): 3, ("lone", "lone"): 0}
    assert [tuple(r) for r in graph.dangling(edges, nodes).collect()] == [("gone", 1)]
    counts = {(r["kind"], r["resolution"]): r["n_edges"] for r in graph.summary(edges).collect()}
    assert len(counts) == 15 and counts["calls", "resolved"] == 3 and counts["imports", "probable"] == 0


def test_relation_filters_and_distances(spark, small):
    edges, nodes = small
    names = spark.createDataFrame([("a",), ("a",), ("none",)], "name string")

    def texts(**how):
        return sorted(r["target_text"] for r in graph.related(edges, names, **how).collect())

    assert texts() == ["b", "zzz"] and texts(statuses=("resolved",)) == ["b"] and texts(kinds=()) == [] and texts(kinds=("contains",)) == []
    assert texts(direction="incoming") == ["a", "a"] and texts(direction="incoming", kinds={"contains"}) == ["a"]
    pairs = spark.createDataFrame([("mod", "c"), ("mod", "c"), ("c", "mod"), ("a", "a"), ("mod", "none"), ("mod", "lone")], "source string, target string")
    got = {(r["source"], r["target"]): r["distance"] for r in graph.shortest_distances(pairs, edges, nodes, 3).collect()}
    assert got == {("mod", "c"): 3, ("c", "mod"): None, ("a", "a"): 0, ("mod", "lone"): None}
    assert graph.shortest_distances(pairs, edges, nodes, 2).where("source = 'mod' and target = 'c'").first()["distance"] is None


def test_counters_and_the_joined_context(spark):
    rows = [(1, "a", 1, "f", 0, 10, "one two"), (1, "b", 2, "g", 0, 5, "x"), (1, "c", 3, "h", 0, 5, "far too long")]
    df = spark.createDataFrame(rows, "query_id long, item string, rank int, path string, start_byte int, end_byte int, text string")
    packed = context.pack_context(df, 8, counter=F.length)
    assert [r["decision"] for r in packed.orderBy("rank").collect()] == ["selected", "selected", "oversized"]
    assert context.joined_context(packed, df).first()["text"] == "one two\nx"
    for counter, error in ((lambda c: c, TypeError), (lambda c: F.lit(1.5), TypeError), (lambda c: F.lit(True), TypeError)):
        with pytest.raises(error):
            context.pack_context(df, 8, counter=counter)
    with pytest.raises(Exception, match="must not give null or negative"):
        context.pack_context(df, 8, counter=lambda c: F.lit(-1)).collect()
    text = spark.range(1).select(context.block_text(F.lit("m.f"), F.lit("function"), F.lit("m.py"), F.lit(1), F.lit(2), F.lit("def f(): pass"))).first()[0]
    assert text == "=== CODE UNIT ===\nsymbol: m.f\nkind: function\nlocation: m.py:L1-2\ncode:\ndef f(): pass\n=== END CODE UNIT ===\n"


def test_repeated_names_and_missing_gold_are_found(spark):
    symbols = spark.createDataFrame([("m.f", "a"), ("m.f", "b"), ("m.g", "a"), ("m.g", "a")], "qualified_name string, path string")
    assert [tuple(r) for r in resolve.duplicate_names(symbols).collect()] == [("m.f", 2)]
    gold = spark.createDataFrame([(1, "m.f"), (2, "m.none")], "query_id long, item string")
    assert [tuple(r) for r in evaluation.missing_gold(gold, symbols).collect()] == [(2, "m.none")]
    ranked = spark.createDataFrame([(1, "x", "m.f"), (1, "x", "m.f"), (1, "y", "m.f")], "query_id long, mode string, item string")
    assert [tuple(r) for r in evaluation.repeated_items(ranked).collect()] == [(1, "x", "m.f", 2)]


def test_context_decisions(spark):
    rows = [
        (1, "a", 1, "f", 0, 10, "one two three"), (1, "inner", 2, "f", 2, 5, "x"), (1, "touch", 3, "f", 10, 12, "x y"), (1, "big", 4, "g", 0, 9, "w " * 50),
        (1, "late", 5, "h", 0, 9, "q " * 4), (1, "fits", 6, "i", 0, 9, "z"), (1, "a", 7, "j", 0, 9, "z"), (1, "nospan", 8, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "query_id long, item string, rank int, path string, start_byte int, end_byte int, text string")
    out = {r["rank"]: (r["decision"], r["used"]) for r in context.pack_context(df, 7).collect()}
    assert out == {1: ("selected", 3), 2: ("overlap", 3), 3: ("selected", 5), 4: ("oversized", 5), 5: ("budget", 5), 6: ("selected", 6), 7: ("duplicate", 6), 8: ("selected", 6)}
    with pytest.raises(ValueError):
        context.pack_context(df, -1)


def test_metrics_and_pairs(spark):
    ranks = spark.createDataFrame([(i, "c", "m", r) for i, r in enumerate([1, 5, None, 10])] + [(i, "c", "n", r) for i, r in enumerate([1, 6, None, None])], "query_id long, category string, mode string, rank int")
    m = {(r["category"], r["mode"]): r for r in evaluation.metrics(ranks).collect()}["all", "m"]
    assert (m["hit_1"], m["hit_5"], m["hit_10"], m["mrr_10"]) == (0.25, 0.5, 0.75, 0.325)
    assert [tuple(r) for r in evaluation.pairwise(ranks, [("m", "n")]).collect()] == [("m", "n", 2, 2, 0)]


def test_change_set_and_merge(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, h string")
    new = spark.createDataFrame([("b", "2"), ("c", "9"), ("d", "4")], "path string, h string")
    changes = incremental.change_set(old, new, ["path"], "h")
    assert {tuple(r) for r in changes.collect()} == {("a", "deleted"), ("c", "changed"), ("d", "added"), ("b", "unchanged")}
    touched = changes.where("change <> 'unchanged'")
    merged = incremental.merge(old, new.join(touched, "path", "left_semi"), touched, "path")
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, new.collect()))


def test_scope_walk_and_stems(spark):
    symbols = spark.createDataFrame([("p.m.f", "p.m", "function"), ("p.f", "p", "function"), ("p.m.g", "p.m", "function"), ("q::h(int)", "q", "function"), ("q::h(bool)", "q", "function")], "qualified_name string, parent string, kind string")
    facts = spark.createDataFrame([(1, "p.m.g", "f"), (2, "p.x.g", "f"), (3, "q::k()", "h"), (4, "p.m.g", "none")], "fact_id long, source string, target_text string")
    got = {r["fact_id"]: (r["depth"], r["n_matches"], r["target"]) for r in resolve.scope_walk(facts, symbols).collect()}
    assert got == {1: (0, 1, "p.m.f"), 2: (1, 1, "p.f"), 3: (0, 2, None)}
    stems = {r["stem"]: r["qualified_name"] for r in resolve.unique_stems(symbols).collect()}
    assert stems == {"f": None, "g": "p.m.g", "h": None}


def test_dense_search_blocks_agree(spark):
    rows = [(i, "g" if i % 2 else "h", [math.sin(i + k) for k in range(8)]) for i in range(40)]
    v = spark.createDataFrame(rows, "item long, group string, vector array<double>")
    q = v.where("item < 6").withColumnRenamed("item", "query_id")
    one = {tuple(r) for r in dense.dense_search(q, v, 3).collect()}
    many = {tuple(r) for r in dense.dense_search(q, v, 3, block=7).collect()}
    assert one == many and len(one) == 18


PY_FILES = [
    ("pkg/__init__.py", ""),
    ("pkg/base.py", "class Base:\n    def run(self):\n        return self.step()\n    def step(self): ...\n"),
    ("pkg/use.py", "import os.path as p\nfrom .base import Base as B\nfrom pkg import base\n\n@deco\nclass D(B, metaclass=M):\n    @prop\n    async def go(self, x=1):\n        self.go()\n        y = base.Base(x)\n        return helper(y)  # done\n\ndef helper(z):\n    def inner():\n        return z\n    if z:\n        class Late: pass\n    return B\n"),
    ("bad.py", "def f(:\n"),
]


def test_python_extraction(spark):
    from codeloom.operators.extract_python import python_facts, python_symbols, resolve_python

    files = spark.createDataFrame([(*f, "x") for f in PY_FILES] + [(None, "x", "x"), ("n.py", None, "x")], "path string, content string, kind string")
    symbols = python_symbols(files).cache()
    got = {r["qualified_name"]: r for r in symbols.collect()}
    assert set(got) == {"pkg", "pkg.base", "pkg.base.Base", "pkg.base.Base.run", "pkg.base.Base.step", "pkg.use", "pkg.use.D", "pkg.use.D.go", "pkg.use.helper", "pkg.use.helper.inner", "pkg.use.helper.Late", "bad"}
    assert got["bad"]["has_syntax_errors"] and got["bad"]["kind"] == "module"
    assert got["pkg.use.D.go"]["kind"] == "method" and got["pkg.use.helper.inner"]["kind"] == "function"
    assert got["pkg.use.D.go"]["signature"] == "async def go(self, x=1)"
    assert got["pkg.use.D.go"]["source_text"].startswith("@prop") and got["pkg.use.D.go"]["source_text"].endswith("# done")
    edges = {(r["kind"], r["source"], r["target_text"]): (r["target"], r["resolution"]) for r in resolve_python(python_facts(files), symbols).collect()}
    assert edges["imports", "pkg.use", ".base.Base"] == ("pkg.base.Base", "resolved")
    assert edges["imports", "pkg.use", "os.path"] == (None, "unresolved")
    assert edges["inherits", "pkg.use.D", "B"] == ("pkg.base.Base", "resolved")
    assert edges["inherits", "pkg.use.D", "metaclass=M"][1] == "unresolved"
    assert edges["calls", "pkg.use.D.go", "self.go"] == ("pkg.use.D.go", "probable")
    assert edges["calls", "pkg.use.D.go", "base.Base"] == ("pkg.base.Base", "resolved")
    assert edges["calls", "pkg.use.D.go", "helper"] == ("pkg.use.helper", "resolved")
    assert edges["references", "pkg.use.helper", "B"] == ("pkg.base.Base", "resolved")
    assert edges["calls", "pkg.base.Base.run", "self.step"] == ("pkg.base.Base.step", "probable")


def test_cpp_extraction(spark):
    from codeloom.operators.extract_cpp import canonical_parameters, cpp_symbols

    text = 'namespace a::b {\nclass W : public V {\npublic:\n  W(int x) : y(x) {}\n  bool ok(const std::string& s, unsigned long n = 3) const { return s == "}{"; }\n  int y;\n};\nint W2::f() { return 1; }\nstatic void hid(char* p) { if (p) { } }\nint proto(int);\nenum E { A };\n}\nvoid open() {\n'
    rows = cpp_symbols(spark.createDataFrame([("d/w.cc", text), (None, "x"), ("e.h", None)], "path string, content string")).collect()
    assert {(r["qualified_name"], r["kind"]) for r in rows} == {
        ("@file:d/w.cc", "module"), ("@namespace:d/w.cc:0:a::b", "namespace"), ("a::b::W", "class"), ("a::b::W::W(int)", "method"),
        ("a::b::W::ok(const std::string&, unsigned long) const", "method"), ("a::b::W2::f()", "function"), ("@filelocal:d/w.cc::a::b::hid(char*)", "function"),
    }
    assert canonical_parameters("std::map<int, int> m, T&& t = f(1, 2), const char *argv[], ...") == "std::map<int, int>, T&&, const char*[], ..."


def test_cpp_relations(spark):
    from codeloom.operators.extract_cpp import cpp_facts, cpp_symbols, resolve_cpp

    a = '#include <vector>\n#include "b.hpp"\n// #include "no.hpp"\nnamespace n {\nclass D : public Base, private T<int> {\n  void m() { this->k(); helper(1); obj.k(); twice(); }\n  void k() {}\n};\nvoid helper(int x) { int local(3); auto f = x; f(2); Base::make(); other::go(); D d(1); return helper(x); }\nvoid twice() {}\nvoid twice(int) {}\n}\n'
    b = "namespace n { class Base { static void make() {} }; }\nnamespace other { void go() {} }\n"
    files = spark.createDataFrame([("src/a.cpp", a), ("src/b.hpp", b), (None, "x"), ("e.h", None)], "path string, content string")
    got = {(r["kind"], r["source"], r["target_text"]): (r["target"], r["resolution"]) for r in resolve_cpp(cpp_facts(files), cpp_symbols(files)).collect()}
    assert got == {
        ("imports", "@file:src/a.cpp", "<vector>"): (None, "unresolved"),
        ("imports", "@file:src/a.cpp", '"b.hpp"'): ("@file:src/b.hpp", "resolved"),
        ("inherits", "n::D", "Base"): ("n::Base", "resolved"),
        ("inherits", "n::D", "T<int>"): (None, "unresolved"),
        ("calls", "n::D::m()", "k"): got["calls", "n::D::m()", "k"],
        ("calls", "n::D::m()", "helper"): ("n::helper(int)", "resolved"),
        ("calls", "n::D::m()", "twice"): (None, "unresolved"),
        ("calls", "n::helper(int)", "f"): (None, "unresolved"),
        ("calls", "n::helper(int)", "Base::make"): ("n::Base::make()", "probable"),
        ("calls", "n::helper(int)", "other::go"): ("other::go()", "resolved"),
        ("calls", "n::helper(int)", "helper"): ("n::helper(int)", "resolved"),
    }
    assert {(r["target"], r["resolution"]) for r in resolve_cpp(cpp_facts(files), cpp_symbols(files)).where("target_text = 'k'").collect()} == {("n::D::k()", "probable"), (None, "unresolved")}
