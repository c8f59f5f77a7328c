import ast
import glob
import random
import sysconfig
import warnings

import pytest

from codeloom.llm import cpp_syntax
from codeloom.llm.derivatives import Grammar
from codeloom.llm.syntax_check import check_files, check_text, error_rates


def parses(text):
    """The interpreter's own verdict."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text.removeprefix("\ufeff"))
        return True
    except (SyntaxError, ValueError):
        return False


def test_derivatives_of_a_small_grammar():
    g = Grammar("list: '[' [item (',' item)*] ']'\nitem: NUM | list\n", "list")
    assert g.failure("[ NUM , [ ] ]".split()) is None
    assert g.failure("[ NUM NUM ]".split()) == 2  # the exact failing token
    assert g.failure("[ NUM ,".split()) == 3  # breaks off
    g.reset()
    assert g.failure(["["] * 3000 + ["]"] * 3000) is None


def test_python_agrees_with_the_interpreter():
    rng = random.Random(1)
    files = rng.sample(sorted(glob.glob(sysconfig.get_path("stdlib") + "/*.py")), 60)
    for f in files:
        text = open(f, encoding="utf8", errors="replace").read()
        lines = text.split("\n")
        k = rng.randrange(len(lines))
        for variant in (text, "\n".join(lines[:k]), "\n".join(lines[:k] + lines[k + 1 :]), text.replace(")", "", 1), text.replace(":", "", 1)):
            assert check_text(variant, "python")[0] != parses(variant), f


PY_GOOD = ["", "\n", "﻿x = 1\r\n", "x = 1\ry = 2\r", "def f[T](a, /, b: int = 1, *c, d, **e) -> T: ...\n", "match x:\n    case [1, *_] | {'a': b, **c} if y: pass\n", "match = case = type = _ = 1\n", "print(f'{x!r:>{w}} {y=}')\n", "with (open(a) as b, c): pass\n",
           "async def f():\n    return [x async for x in y if await z]\n", "type X[T] = list[T]\n", "try: pass\nexcept* E as e: pass\n", "a[1:2, ::3] = *b, c\n", "lambda *, a=1, **k: (yield)\n", "@a.b(c)\nclass D(E, metaclass=F): x: int = 3\n"]
PY_BAD = ["def f(:\n", "x = (1\n", "print 'x'\n", "if x\n    pass\n", "  x = 1\n", "f() = 1\n", "def f(a=1, b): pass\n", "f(a=1, b)\n", "'abc\n", "\"\"\"abc", "x = 1 +\n", "<<<<<<< HEAD\n", "a\0b", "not x = 1\n", "b'é'\n", "'\\x1'\n", "for x in y:\n", "1a\n", "x = y z\n", "else: pass\n", "f'{x'\n"]


@pytest.mark.parametrize("text", PY_GOOD)
def test_python_good(text):
    assert parses(text) and not check_text(text, "python")[0]


@pytest.mark.parametrize("text", PY_BAD)
def test_python_bad(text):
    assert not parses(text) and check_text(text, "python")[0]


CPP_GOOD = ["", "﻿#pragma once\r\nint x;\r\n", "namespace a::b { int f(const std::vector<std::map<int, int>>& x) const; }", "template <typename T, int N = 3> struct A : public B<T>, C { A() : B<T>(1), x{2} {} ~A() = default; virtual void f() const noexcept override = 0; private: int x = 0; };",
            "int main() { for (auto& [k, v] : m) { if (auto it = m.find(k); it != m.end()) continue; else break; } do { --n; } while (n > 0 && !done); switch (n) { case 1: case 2: f(); break; default: break; } return a < b ? 1 : 2; }",
            "auto f = [&, x = 1](int a) mutable -> int { return a * x; };", "enum class E : int { A = 1, B, };", "const char* s = R\"x(a \" ) b)x\";", "#if A\nint x;\n#else\nint y;\n#endif\n", "int x = 1'000'000 + 0xFFu + 1.5e-3f;", "template <class T> concept C = requires(T a) { a + a; { a.f() } -> S<int>; };",
            "using X = std::function<void(int)>; typedef unsigned long ul; static_assert(sizeof(int) == 4, \"x\");", "void f() { try { throw E(\"x\"); } catch (const E& e) { } catch (...) { } int a[3] = {1, 2, 3}; auto* p = new int[4]; delete[] p; (void)p; x->y.z()[1]++; goto end; end: ; }", "bool operator==(const A& a, const A& b) { return a.x == b.x; }", "extern \"C\" { void g(); }",
            "struct S { int a : 3; static constexpr int k = 2; friend class T; explicit operator bool() const { return true; } };"]
CPP_BAD = ["int f( { }", "int f() { return 1 }", "int f() { return 1; ", "}", "class A { int x; }", "int f() { if x { } }", "<<<<<<< HEAD\nint x;\n", "int x = 'ab;", "const char* s = \"abc;", "/* abc", "def f(): pass", "return 1;", "#if A\nint x;\n", "#endif\n", "int 1x;", "int f() { return {} + ; }", "int x = 09;", "namespace a { int f() { return 1; } ", "import os", "int f() { else { } }", "# Not a directive\n"]


@pytest.mark.parametrize("text", CPP_GOOD)
def test_cpp_good(text):
    assert not check_text(text, "cpp")[0], cpp_syntax.tokens(text)


@pytest.mark.parametrize("text", CPP_BAD)
def test_cpp_bad(text):
    assert check_text(text, "cpp")[0]


@pytest.mark.parametrize("text", ["x = (1,", "def f(", "if a:\n x = [1, 2", '"""abc', "x = 'abc", "x = 1 +", "def f():\n  try:\n    x = 1\n", "f'{x", "if x:\n", "x = 1\\"])
def test_python_that_breaks_off(text):
    assert not parses(text) and check_text(text, "python")[1] == "truncated"


def test_exact_failing_token_of_python():
    assert check_text("x = (1\ny = 2\n", "python") == (True, "error", 4, 7)
    assert check_text("x = 'abc\ny = 1\n", "python")[1:3] == ("error", 2)
    assert check_text("x = " + "-" * 20_000 + "\n", "python")[:2] == (True, "error")  # the interpreter gives up here


@pytest.mark.parametrize("text", ["/* abc", "int f() {", 'const char* s = "abc;', 'R"x(abc', "#if A\nint x;\n", "#if A\nint x = f(\n#endif"])
def test_cpp_that_breaks_off(text):
    assert check_text(text, "cpp")[1] == "truncated"


@pytest.mark.parametrize(
    ("text", "at"),
    [
        ("#if A\nint y;\n#else\nint y = ;\n#endif\n", 6),
        ("#if A\nint y;\n#elif B\nint y = ;\n#elif C\n#endif\n", 6),
        ("#ifndef H\n#if A\nint x;\n#elif B\nint = 1;\n#endif\n#endif\n", 4),
        ("#if 1\nint y;\n#else\nint y = ;\n#endif\n", None),
        ("#if 0\ndon't [\n#endif\nint x;\n", None),
        ('#ifdef C\nextern "C" {\n#endif\nint f();\n#ifdef C\n}\n#endif\n', None),
        ("#ifdef A\nvoid f(int a) {\n#else\nvoid f(long a) {\n#endif\n}\n", None),
        ("#ifndef A\nint x\n#else\nint y\n#endif\n;\n  # ifdef A\nint z;\n  # endif\n", None),
        ("int x;\n#else\n", 3),
        ("#if A\n#else\n#else\n#endif\n", 0),
    ],
)
def test_every_branch_of_a_conditional_is_read(text, at):
    assert check_text(text, "cpp")[2] == at


def test_files(spark):
    rows = [(1, "r", " a.PY ", "x = 1\n"), (2, "r", "b.py", "x = ("), (3, "r", "c.hpp", "int f() {"), (4, "q", "d.txt", "((("), (5, "q", "e.cc", None), (6, None, "f.h", ""), (2, "r", "b.py", "x = ("), (None, "r", "g.py", "x"), (8, "r", None, "x"), (9, "q", "h.py", "x = [" + "1, " * 200_000 + "]\n")]
    df = spark.createDataFrame([(*r, "python", "no") for r in rows], "file_id long, repo string, path string, content string, language string, failure string")
    out = check_files(df)
    got = sorted((r["file_id"] or 0, r["has_syntax_errors"], r["failure"]) for r in out.collect())
    assert got == [(0, False, None), (1, False, None), (2, True, "truncated"), (2, True, "truncated"), (3, True, "truncated"), (6, False, None), (9, False, None)]
    rates = {(r["repo"], r["language"]): (r["n_files"], r["n_invalid"]) for r in error_rates(out).collect()}
    assert rates["r", "python"] == (4, 2) and rates["r", "cpp"] == (1, 1)
    assert check_files(df.limit(0)).count() == 0
