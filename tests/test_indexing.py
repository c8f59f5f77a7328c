import hashlib
import json

import pytest
from pyspark.sql import functions as F

from codeloom.operators.lexical import with_path_prefix
from codeloom.plans.indexing import index_repository
from codeloom.sources.repository import scan_repository
from codeloom.sources.store import IndexStore
from codeloom.streaming.changes import LISTING, follow_listings


def lay(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


def contents(spark, index):
    store = IndexStore(spark, index)
    return {t: sorted(map(str, store.read(t).select(*sorted(store.read(t).columns)).collect())) for t in ("files", "symbols", "code_units", "relations")}


def test_scan(spark, tmp_path):
    lay(tmp_path, {"a/b/c/d.py": "x = 1\n", "a/__init__.py": "", "_p.py": "é", ".h/x.py": "y", "a/dist/n.py": "n", "a/b/.git/n.py": "n", "py": "n", "a/n.pyc": "n"})
    (tmp_path / "bad.PY").write_bytes(b"\xff\n")
    got = {r["path"]: (r["content"], r["content_sha256"]) for r in scan_repository(spark, str(tmp_path)).collect()}
    want = {"a/b/c/d.py": b"x = 1\n", "a/__init__.py": b"", "_p.py": "é".encode(), ".h/x.py": b"y", "bad.PY": b"\xff\n"}
    assert {k: v[1] for k, v in got.items()} == {k: hashlib.sha256(v).hexdigest() for k, v in want.items()} and got["bad.PY"][0] == "\ufffd\n"
    assert [r["path"] for r in scan_repository(spark, str(tmp_path / "_p.py")).collect()] == ["_p.py"]
    assert scan_repository(spark, str(tmp_path / "py")).count() == 0 and scan_repository(spark, str(tmp_path / "a/b/c"), ("cpp",)).count() == 0
    with pytest.raises(FileNotFoundError):
        scan_repository(spark, str(tmp_path / "none"))


def work(done):
    return tuple(done[k] for k in ("mode", "files_analyzed", "relation_files_recomputed", "symbols_rewritten", "code_units_rewritten"))


def test_a_cpp_repository_and_the_language_guard(spark, tmp_path):
    repo, index = tmp_path / "repo", str(tmp_path / "i")
    lay(repo, {"a.cpp": '#include "b.hpp"\r\nint g() { return f(); }\n', "b.hpp": "struct D : public A<int>, public virtual B<char, int> { int x; };\nint f() { return 1; }\n", "c.py": "x = 1\n"})
    assert work(index_repository(spark, str(repo), index, language="cpp")) == ("full", 2, 2, 5, 3)
    store = IndexStore(spark, index)
    assert {r["source_text"] for r in store.read("code_units").collect()} == {"int g() { return f(); }", "struct D : public A<int>, public virtual B<char, int> { int x; }", "int f() { return 1; }"}
    edges = {(r["kind"], r["target_text"], r["resolution"]) for r in store.read("relations").collect()}
    assert {("inherits", "A<int>", "unresolved"), ("inherits", "B<char, int>", "unresolved"), ("imports", '"b.hpp"', "resolved"), ("calls", "f", "resolved")} <= edges
    with pytest.raises(ValueError, match="holds cpp files"):
        index_repository(spark, str(repo), index)
    assert index_repository(spark, str(repo), index, full=True)["files"] == 1


def test_a_write_that_stops_leaves_the_index(spark, tmp_path):
    repo, index = tmp_path / "repo", str(tmp_path / "i")
    lay(repo, {"x.py": "def f(): pass\n"})
    index_repository(spark, str(repo), index)
    (tmp_path / "i" / "pointer.2").mkdir()  # stopped before its _SUCCESS
    assert IndexStore(spark, index).current() == 1
    lay(repo, {"x.py": "def g(): pass\n"})
    index_repository(spark, str(repo), index)
    assert IndexStore(spark, index).current() == 2
    store = IndexStore(spark, index)
    bad = spark.createDataFrame([("x.g", "m", "f", [float("nan")])], "qualified_name string, model_id string, fingerprint string, vector array<float>")
    for vectors in (bad, bad.limit(0), bad.withColumn("qualified_name", F.lit("none"))):
        with pytest.raises(ValueError, match="do not fit"):
            store.write_vectors(vectors)
    assert store.read_vectors().count() == 0


def test_incremental_equals_full(spark, tmp_path):
    repo, a, b = tmp_path / "repo", str(tmp_path / "a"), str(tmp_path / "b")
    lay(repo, {"m/x.py": "def f():\n    return 1\n", "m/y.PY": "from m.x import f\ndef g():\n    f()\n", "build/no.py": "x", "m/z.txt": "no", ".venv/n.py": "x"})
    assert {r["path"] for r in scan_repository(spark, str(repo)).collect()} == {"m/x.py", "m/y.PY"}
    assert index_repository(spark, str(repo), a)["mode"] == "full"
    assert work(index_repository(spark, str(repo), a)) == ("noop", 0, 0, 0, 0)
    lay(repo, {"m/x.py": "def f():\n    return 2\n"})
    assert work(index_repository(spark, str(repo), a)) == ("incremental", 1, 1, 2, 1)
    lay(repo, {"m/x.py": "def renamed():\n    return 2\n", "m/w.py": "class W: pass\n"})
    done = index_repository(spark, str(repo), a)
    assert work(done) == ("incremental", 2, 3, 4, 2)
    assert [done[f"files_{c}"] for c in ("added", "changed", "deleted", "unchanged")] == [1, 1, 0, 1] and (done["files"], done["symbols"], done["code_units"]) == (3, 6, 3)
    (repo / "m/w.py").unlink()
    index_repository(spark, str(repo), a)
    index_repository(spark, str(repo), b, full=True)
    assert contents(spark, a) == contents(spark, b)


def test_repeated_names_leave_the_index_alone(spark, tmp_path):
    repo, index = tmp_path / "repo", str(tmp_path / "i")
    lay(repo, {"x.py": "def f(): pass\n"})
    index_repository(spark, str(repo), index)
    before = contents(spark, index)
    lay(repo, {"x/__init__.py": "y = 1\n"})
    with pytest.raises(ValueError, match="more than once"):
        index_repository(spark, str(repo), index)
    assert contents(spark, index) == before
    with pytest.raises(FileNotFoundError):
        IndexStore(spark, str(tmp_path / "none")).read("files")


def test_listings_as_a_stream(spark, tmp_path):
    src, state, out = str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "out")
    spark.createDataFrame([("a", "1"), ("b", "2")], LISTING).coalesce(1).write.mode("append").parquet(src)
    follow_listings(spark, src, state, out, str(tmp_path / "cp")).awaitTermination(60)
    spark.createDataFrame([("b", "3"), ("c", "4")], LISTING).coalesce(1).write.mode("append").parquet(src)
    follow_listings(spark, src, state, out, str(tmp_path / "cp")).awaitTermination(60)
    got = {(r["batch_id"], r["path"], r["change"]) for r in spark.read.parquet(out).collect()}
    assert got == {(0, "a", "added"), (0, "b", "added"), (1, "a", "deleted"), (1, "b", "changed"), (1, "c", "added")}


def test_path_prefixes_are_literal(spark):
    df = spark.createDataFrame([("src/a",), ("SRC/b",), ("s%c/x",), (None,)], "path string")
    assert {r[0] for r in with_path_prefix(df, "src\\", True).collect()} == {"src/a", "SRC/b"}
    assert {r[0] for r in with_path_prefix(df, "src/", False).collect()} == {"src/a"}
    assert {r[0] for r in with_path_prefix(df, "s%", False).collect()} == {"s%c/x"}


def test_command_line(spark, tmp_path, capsys):
    from codeloom.cli import main

    index = str(tmp_path / "i")
    lay(tmp_path / "repo", {"pay.py": "def authorize_payment(x):\n    return charge(x)\n\ndef charge(x):\n    return x\n"})
    main(["index", str(tmp_path / "repo"), "--index", index])
    main(["embed", index])
    assert '"vectors": 2' in capsys.readouterr().out
    main(["search", index, "authorize_payment", "--mode", "reranked", "--explain"])
    out = capsys.readouterr().out
    assert '"item": "pay.authorize_payment"' in out and "graph_base" in out
    main(["search", index, "pay", "--path-prefix", "PAY", "--kind", "function"])
    assert capsys.readouterr().out.count('"item"') == 2
    main(["search", index, "pay", "--kind", "class"])
    assert '"item"' not in capsys.readouterr().out
    main(["inspect", str(tmp_path / "repo" / "pay.py")])
    assert '"signature": "def charge(x)"' in capsys.readouterr().out
    main(["context", index, "authorize_payment", "--budget", "100"])
    assert '"decision": "selected"' in capsys.readouterr().out
    main(["graph", index])
    assert '"n_edges": 2' in capsys.readouterr().out
    query = {"id": "q1", "category": "lexical", "query": "authorize_payment", "relevant_qnames": ["pay.authorize_payment"], "showcase": False, "notes": ""}
    (tmp_path / "b.json").write_text(json.dumps({"benchmark_version": 1, "benchmark_id": "b", "language": "python", "queries": [query]}))
    main(["benchmark", index, str(tmp_path / "b.json")])
    out = capsys.readouterr().out
    assert "| lexical | reranked | 1 | 1.0000 |" in out and "| q1 | dense | 1 |" in out
    query["showcase"] = True
    (tmp_path / "b.json").write_text(json.dumps({"benchmark_version": 1, "benchmark_id": "b", "language": "python", "queries": [query]}))
    main(["benchmark", index, str(tmp_path / "b.json"), "--json"])
    report = json.loads(capsys.readouterr().out)
    assert report["showcases"][0]["item"] == "pay.authorize_payment" and {m["hit_1"] for m in report["metrics"] if m["mode"] == "lexical"} == {"1.0000"}
    with pytest.raises(ValueError, match="not a complete benchmark"):
        main(["benchmark", index, str(tmp_path / "b.json"), "--complete"])
    (tmp_path / "b.json").write_text(json.dumps({"benchmark_version": 1, "queries": [query, query]}))
    with pytest.raises(ValueError, match="repeated"):
        main(["benchmark", index, str(tmp_path / "b.json")])


def test_vectors_are_reused(spark):
    from codeloom.operators.embedding import HashedWords, embed_units

    class Counting(HashedWords):
        def embed_documents(self, texts):
            if any("keep" in t for t in texts):
                raise RuntimeError("embedded again")
            return super().embed_documents(texts)

    schema = "qualified_name string, signature string, source_text string"
    old = embed_units(spark.createDataFrame([("m.keep", "s", "t"), ("m.gone", "s", "t"), ("m.edit", "s", "t")], schema), HashedWords()).cache()
    new = embed_units(spark.createDataFrame([("m.keep", "s", "t"), ("m.edit", "s", "u"), ("m.new", None, None)], schema), Counting(), old)
    got = {r["qualified_name"]: r["vector"] for r in new.collect()}
    assert set(got) == {"m.keep", "m.edit", "m.new"} and got["m.keep"] == {r["qualified_name"]: r["vector"] for r in old.collect()}["m.keep"]
