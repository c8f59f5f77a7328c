import ast
import random
from itertools import permutations

import pytest

from codeloom.llm.docpairs import CPP, PYTHON, Comment, Function, assign, describe, documented_functions, is_trivial, link_comment, link_score, scan_python


def test_assignment_is_optimal():
    rng = random.Random(1)
    for _ in range(30):
        n, m = rng.randrange(1, 5), rng.randrange(5, 7)
        s = [[rng.random() for _ in range(m)] for _ in range(n)]
        best = max(sum(s[i][p[i]] for i in range(n)) for p in permutations(range(m), n))
        assert sum(s[i][j] for i, j in enumerate(assign(s))) == pytest.approx(best)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ('def f(a, b):\n    """Adds the two numbers."""\n    return a', True),
        ('def f(a):\n    # Adds numbers.\n    return a', False),
        ('def f(a):\n    x = 1\n    """Adds the two numbers."""', False),
        ('def f(a):\n    def g():\n        """Inner text about things."""\n    return g', False),
        ('def f(a):\n    def g():\n        """Inner text."""\n    """Too late to count."""', False),
        ('def f(a):\n    f"""Not a docstring {a}."""', False),
        ('def f(a):\n    b"""Bytes are none either."""', False),
        ('def f(a):\n    """Text of docs.""".strip()', False),
        ('def f(a):\n    ("Adds "\n     "two numbers.")\n    return a', True),
        ('def f(a: dict = {"x": [1]}) -> "str":  # note\n\n    r"""Maps the key to \\w."""', True),
        ('@deco("x:y")\n    async def f(self):\n        "Waits for the answer."; return 1', True),
        ('def f(a): "One line that explains."', True),
        ('def fetch_user(user_id):\n    """Fetch user."""', False),
        ('def fetch_user(user_id):\n    """Fetches the user.\n\n    Args:\n        user_id:\n\n    Returns:\n    """', False),
        ('def f(a):\n    """TODO(me): write docs"""', False),
        ('def f(a):\n    """..."""', False),
        ('def f(a):\n    """x = compute(5)\n    return x"""', False),
        ('def f(a):\n    """Der Zähler wird zurückgesetzt."""', True),
        ('def f(a):\n    """noqa: D102"""', False),
        ("", False), ("   ", False), (None, False), ("def", False), ('def broken(:\n """x', False), ("class A:\n    pass", False),
    ],
)
def test_python(text, found):
    got = describe(text, PYTHON)
    assert (got is not None and got[1]) == found


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("/// Adds two numbers to the sum.\nint f(int a) { return a; }", True),
        ("/** Adds two numbers.\n * @param a the first\n */\nint f(int a) { return a; }", True),
        ("int f(int a) { // Adds two numbers.\n return a; }", False),
        ("// NOLINTNEXTLINE(readability-x)\nint f(int a) { return a; }", False),
        ("// clang-format off\nint f(int a) { return a; }", False),
        ("// int old = compute(5);\n// return old;\nint f(int a) { return a; }", False),
        ("/*********/\nint f(int a) { return a; }", False),
        ("/// fetchUser\n/// \\param user_id\nint fetchUser(long user_id) {}", False),
        ("//! Tbd - add a description\nint f() {}", False),
        ("/*! Sucht den Eintrag.\n*/\nint f() {}", True),
        ("int f() {}", False),
    ],
)
def test_cpp(text, found):
    got = describe(text, CPP)
    assert (got is not None and got[1]) == found


def test_no_docstring_is_lost_to_another_comment():
    text = 'def outer(alpha):\n    """Runs the thing.\n\n    :param beta: of the inner one\n    """\n{}    def inner(beta):\n        return beta\n    return inner\n'
    assert describe("@deco\n    # :param alpha: how far it goes\n    " + text.format(""), PYTHON)[0].startswith("Runs the thing.")
    assert describe(text.format("    # :param alpha: how far it goes\n"), PYTHON)[1]
    assert describe(text.format("    # :param beta: how far it goes\n    # :param alpha: and back\n"), PYTHON)[1]


def test_tags_names_and_distance_pick_among_comments():
    # No docstring: the nearest comment with the function's own parameters is linked, out of place.
    text = "def outer(alpha, gamma):\n    # :param alpha: how far the walk goes\n    # :param gamma: how fast\n    x = 1\n    # :param beta: depth of the nested step\n    def inner(beta):\n        return beta\n    return inner\n"
    functions, comments = scan_python(text)
    assert [link_comment(functions, comments, i) for i in (0, 1)] == [0, 1]
    got = describe(text, PYTHON)
    assert got[0].startswith(":param alpha:") and not got[1]
    # Both functions would take the first comment; the assignment gives each one of its own.
    f, g = Function("f", ["a", "b"], 0, 10), Function("g", ["a", "b"], 60, 70)
    shared, worse = Comment("f", 11, 30, None, {"a", "b"}), Comment("", 20, 40, None, {"a", "b"})
    assert [link_comment([f, g], [shared, worse], i) for i in (0, 1)] in ([0, 1], [1, 0])
    total = sum(link_score(x, c, i) for i, (x, c) in enumerate(zip((f, g), ((shared, worse), (worse, shared))[link_comment([f, g], [shared, worse])])))
    assert total == pytest.approx(max(link_score(f, a, 0) + link_score(g, b, 1) for a, b in ((shared, worse), (worse, shared))))
    # Far away or without tags: implausible.
    assert describe("def f(a):\n    # Explains it well.\n    return a", PYTHON) is None
    assert describe("def f(a):\n" + "    a = a + 1\n" * 100 + "    # :param a: far from here\n", PYTHON) is None


def test_blocks_before_a_cpp_definition():
    assert describe("// License of the file.\n\n/// Adds two numbers.\nint f(int a) {}", CPP) == ("Adds two numbers.", True)
    assert describe("/// Adds two numbers.\n\nint f(int a) {}", CPP) is None
    assert describe("/// \\param a adds two numbers\n\nint f(int a) {}", CPP) == ("\\param a adds two numbers", False)
    assert describe("/// Holds things.\nclass A : public B<int> {\n /// Adds two.\n int f(int a); };", CPP) is None


def test_docstrings_as_python_defines_them():
    rng = random.Random(3)
    pieces = ['"""Doc\\n text."""', "'x' \"y\"", 'f"no"', 'b"no"', "# c\n    'after comment'", "x = 'no'", "'a' % 1", "('a'\n 'b')", "pass", 'r"raw\\d"', "'t';pass"]
    for _ in range(200):
        p = rng.choice(pieces)
        text = f"def name(a, b=')', *c: {{'k': lambda: 1}}) -> 'T':\n    {p}\n    return 1\n"
        want = ast.get_docstring(ast.parse(text).body[0], clean=False)
        got = [c.text for c in scan_python(text)[1] if c.owner == 0]
        assert (got[0] if got else None) == want, text


def test_long_text_is_read_whole():
    assert describe("def f(a):\n    '''Explains it.'''\n" + "    a = 'x'  # y\n" * 100_000, PYTHON)
    assert is_trivial("", "f", []) and is_trivial("!!!", "f", []) and not is_trivial("Resets counters.", "f", ["a"])


def test_tables(spark):
    units = spark.createDataFrame(
        [("m.f", "a.py", 'def f(a):\n    """Good text about a file."""', 2, "x"), ("m.f", "a.py", "def f(a):\n    pass", 1, "x"), ("m.g", "a.py", 'def g():\n    """Older good text."""', 1, "x"), ("m.g", "a.py", "def g(): pass", 3, "x"),
         ("m.C", "a.py", 'class C:\n    """Text of a class."""', 1, "x"), ("m.h", None, "/// Text about h as such.\nint h() {}", 1, "x"), (None, "a.py", "def f(): 'text here'", 1, "x"), ("m.i", "a.py", None, None, "x")],
        "qualified_name string, path string, source_text string, version int, description string",
    )
    kinds = spark.createDataFrame([("m.f", "method", 1), ("m.f", "class", 0), ("m.g", "function", 1), ("m.C", "class", 1), ("m.h", "function", None), (None, "function", 1), ("m.i", None, 1)], "qualified_name string, kind string, version int")
    got = {r["qualified_name"]: r["description"] for r in documented_functions(units, kinds).collect()}
    assert got == {"m.f": "Good text about a file.", "m.h": "Text about h as such."}
    assert documented_functions(units.limit(0), kinds.limit(0)).count() == 0
