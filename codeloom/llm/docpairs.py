"""Functions paired with their documentation.

Each unit of source text is scanned for functions and for candidate comments
(string statements and comments).  Position, parameter tags, names and distance
score the links between them, implausible ones are rejected, a bipartite
assignment picks the best set of those that remain, and descriptions that say
nothing are dropped.
"""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.latest import latest_by

PYTHON, CPP = "python", "cpp"
#: Least score of a link.  A docstring or a comment directly before the definition has more than twice what any
#: other link can reach, so no assignment gains by taking it from its function; a comment elsewhere needs both
#: parameter tags and nearness.
PLAUSIBLE = 2.0
OWN, TAGS, NAMED, NEAR = 6.0, 1.5, 0.25, 1.0
#: Links over a greater distance (characters) than this cannot be plausible: NEAR / (1 + gap / 100) is too small.
FARTHEST = int(100 * (NEAR / (PLAUSIBLE - TAGS - NAMED) - 1))

#: Words that only frame a description.
GLUE = frozenset(
    """this the a an function method procedure routine for of to that which it is and or with by return returns returned args
    arguments argument parameters parameter param params tparam raises raise yields self cls def class type types rtype brief
    fn retval""".split()
)
#: Words of placeholders and of reminders to document.
PLACEHOLDER = frozenset(
    """todo tbd fixme xxx hack wip do document documentation docs doc docstring documented undocumented description describe
    descriptions missing write add later here placeholder generated stub auto autogenerated none n a na nil null no comment
    comments pending fill in complete needs need needed me be done soon text summary explain explanation not yet available
    please should must empty nothing insert your
    dokumentieren dokumentation beschreibung beschreiben fehlt folgt noch keine kein hier später ergänzen
    documentar documentación descripción describir falta pendiente sin añadir aquí luego""".split()
)
_DIRECTIVE = re.compile(
    r"(?i)^\W*(?:nolint\w*|clang-(?:format|tidy)|noqa|type:\s*ignore|pylint|pragma|cppcheck-suppress|coverity|nosonar|iwyu|lcov_excl\w*|gcovr?_excl\w*"
    r"|fmt:\s*(?:off|on|skip)|yapf|isort|mypy|flake8|ruff|pyright|pyre-\w+|black|autopep8|vim?:|-\*-|@?formatter:|eslint|sourcery|codespell|bandit|nosec|doctest)\b"
)
_OWNER = re.compile(r"(?i)\b(todo|to do|tbd|fixme|xxx|hack)\s*[(\[][^)\]]*[)\]]")
_TAG = re.compile(r"(?im)^\s*(?:[@\\](?:t?param)(?:\[[^\]]*\])?\s+(\w+)|:param(?:\s+[\w.\[\], ]+?)?\s+(\w+)\s*:|(\w+)\s*(?:\([^)\n]*\))?\s*:(?=\s))")
_WORD = re.compile(r"[A-Z]+(?![a-zà-ÿ])|[A-Z]?[^\W\d_A-Z]+|[^\W\d_]+")
_CODE_LINE = re.compile(
    r"^\s*(?:.*[;{}]|(?:[\w.\[\]>*&:<,-]+\s+){0,3}[\w.\[\]>-]+\s*[-+*/|&%]?=\s*[^=\s].*|[\w.:>-]+\([^)]*\);?|(?:return|import|from|del|raise|yield|await)\b\s*[\w.\[\]()]*"
    r"|(?:if|elif|for|while|def|class|with|else|try|except|finally)\b.*:|>>>.*|\.\.\. .*|#\s*(?:include|define|if|endif).*|@\w+)\s*$"
)
_STRING = r"(?i:\b[rbuf]{1,2})?(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')"
_PY = re.compile(rf"(?s)(?P<string>{_STRING})|(?P<comment>\#[^\n]*(?:\n[ \t]*\#[^\n]*)*)|(?P<def>\bdef[ \t\\\n]+(?P<name>\w+))|(?P<open>[(\[{{])|(?P<close>[)\]}}])|(?P<colon>:)")
_PY_MARK = re.compile(r"(?m)^[ \t]*#+[ \t]?")
_SKIP = re.compile(r"(?:[ \t\f\r]*(?:#[^\n]*)?(?:\\\r?\n|\n))*[ \t\f]*")
_ONE_STRING = re.compile(rf"(?s)({_STRING})[ \t\f]*(?:\\\r?\n[ \t\f]*)?")
_STATEMENT_END = re.compile(r"[ \t\f\r]*(?:$|\n|;|#)")
_CPP_LEAD = re.compile(r"(?s)(?:\s+|//[^\n]*(?:\\\n[^\n]*)*|/\*.*?(?:\*/|$))*")
_CPP_PIECE = re.compile(r"(?s)//[^\n]*(?:(?<=\\)\n[^\n]*)*|/\*.*?(?:\*/|$)")
_CLASS = re.compile(r"(?s)(?:\s*template\s*<[^;{()]*>)?\s*(?:class|struct|union|enum|namespace)\b[^({;]*[{;]")
_CPP_ITEM = re.compile(r"(?s)(//[^\n]*(?:\n[ \t]*//[^\n]*)*|/\*.*?\*/)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
_CPP_MARK = re.compile(r"(?m)^[ \t]*(?://[/!]*<?|/\*+[!<]*|\*+(?!/))?[ \t]?|[ \t]*\*+/[ \t]*$")


@dataclass
class Function:
    name: str
    parameters: list[str]
    start: int
    body: int


@dataclass
class Comment:
    text: str
    start: int
    end: int
    owner: int | None = None
    tags: set[str] = field(default_factory=set)


def _stem(word: str) -> str:
    word = word.lower()
    for suffix in ("ing", "ed", "es", "s"):
        if word.endswith(suffix) and len(word) - len(suffix) >= 3:
            word = word[: -len(suffix)]
            break
    return word.rstrip("e")


def _words(text: str) -> list[str]:
    return _WORD.findall(text)


def is_trivial(text: str, name: str, parameters: list[str]) -> bool:
    """Whether a description says nothing: empty, punctuation, a placeholder or reminder,
    a tool directive, commented-out code, or only the function's own names."""
    lines = [line for line in text.splitlines() if line.strip() and not _DIRECTIVE.match(line)]
    if not lines:
        return True
    found = _words(_OWNER.sub(r"\1", "\n".join(lines)))
    if not found:
        return True
    own = {_stem(w) for w in _words(name)} | {_stem(w) for p in parameters for w in _words(p)} | {_stem(p) for p in parameters}
    own.add(_stem(name))
    if all(w.lower() in GLUE or w.lower() in PLACEHOLDER or _stem(w) in own for w in found):
        return True
    code = sum(1 for line in lines if _CODE_LINE.match(line))
    return code * 5 >= len(lines) * 3


def assign(score: list[list[float]]) -> list[int]:
    """The column of each row that maximises the total score (rows <= columns), by the Hungarian method."""
    n, m = len(score), len(score[0])
    u, v, match, way = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    cost = -score[i0 - 1][j - 1] - u[i0] - v[j]
                    if cost < least[j]:
                        least[j], way[j] = cost, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def link_score(function: Function, comment: Comment, index: int) -> float:
    """Position as documentation, parameter tags, the function's name, and nearness."""
    score = OWN if comment.owner == index else 0.0
    if comment.tags and function.parameters:
        score += TAGS * len(comment.tags & set(function.parameters)) / max(len(comment.tags), len(function.parameters))
    if function.name and function.name in comment.text:
        score += NAMED
    gap = min(abs(comment.start - function.body), abs(function.start - comment.end))
    return score + NEAR / (1 + gap / 100)


def plausible_links(functions: list[Function], comments: list[Comment]) -> dict[int, dict[int, float]]:
    """Function -> comment -> score of the links that are plausible: a function's own comment, and comments with
    tags that stand near it."""
    out: dict[int, dict[int, float]] = {i: {} for i in range(len(functions))}
    for j, c in enumerate(comments):
        if c.owner is not None:
            out[c.owner][j] = link_score(functions[c.owner], c, c.owner)
    tagged = [(c.start, j) for j, c in enumerate(comments) if c.tags]
    if tagged:
        tagged.sort()
        longest = max(c.end - c.start for c in comments)
        for i, f in enumerate(functions):
            lo, hi = bisect_left(tagged, (f.start - FARTHEST - longest, -1)), bisect_right(tagged, (f.body + FARTHEST, len(comments)))
            for _, j in tagged[lo:hi]:
                score = link_score(f, comments[j], i)
                if score >= PLAUSIBLE:
                    out[i][j] = score
    return out


def link_comment(functions: list[Function], comments: list[Comment], of: int = 0) -> int | None:
    """The index of the comment that the best assignment of all functions and comments gives to function ``of``.

    Links of functions that no chain of plausible links connects to it cannot bear on it and are left aside.
    """
    links = plausible_links(functions, comments)
    users: dict[int, list[int]] = {}
    for i, row in links.items():
        for j in row:
            users.setdefault(j, []).append(i)
    near, todo = {of}, [of]
    while todo:
        for j in links[todo.pop()]:
            fresh = [i for i in users[j] if i not in near]
            near.update(fresh)
            todo.extend(fresh)
    rows = sorted(near)
    columns = sorted({j for i in rows for j in links[i]})
    if not columns:
        return None
    spare = len(rows)
    got = assign([[links[i].get(j, 0.0) for j in columns] + [0.0] * spare for i in rows])[rows.index(of)]
    return columns[got] if got < len(columns) and columns[got] in links[of] else None


def _docstring(text: str, at: int) -> tuple[str, int, int] | None:
    """The docstring that begins the body at ``at``, as Python defines it."""
    at = _SKIP.match(text, at).end()
    parens, begin = 0, at
    while text.startswith("(", at):
        parens, at = parens + 1, re.compile(r"\(\s*(?:#[^\n]*\s*)*").match(text, at).end()
    literals = []
    while m := _ONE_STRING.match(text, at):
        literals.append(m[1])
        at = m.end()
        if parens:
            at = re.compile(r"\s*(?:#[^\n]*\s*)*").match(text, at).end()
    if not literals or any(x[: x.index(x.lstrip("rRbBuUfF")[0])].lower().strip("ru") for x in literals):
        return None
    while parens and text.startswith(")", at):
        parens, at = parens - 1, at + 1
    if parens or not _STATEMENT_END.match(text, at):
        return None
    value = ""
    for x in literals:
        if "\\" in x:
            try:
                value += ast.literal_eval(x)
                continue
            except (SyntaxError, ValueError):
                pass
        body = x.lstrip("rRuU")
        value += body[3:-3] if body[:3] in ('"""', "'''") and len(body) >= 6 else body[1:-1]
    return value, begin, at


def scan_python(text: str) -> tuple[list[Function], list[Comment]]:
    """Functions of a unit in order (its own first) and the candidate comments."""
    functions: list[Function] = []
    comments: list[Comment] = []
    depth, header, parameters_from = 0, None, 0
    own_strings: set[int] = set()
    for m in _PY.finditer(text):
        kind = m.lastgroup
        if kind == "name" or kind == "def":
            if depth == 0 and header is None:
                header, parameters_from = (m["name"], m.start()), m.end()
        elif kind == "open":
            depth += 1
        elif kind == "close":
            depth = max(0, depth - 1)
        elif kind == "colon":
            if header and depth == 0:
                index = len(functions)
                functions.append(Function(header[0], _python_parameters(text[parameters_from : m.start()]), header[1], m.end()))
                header = None
                found = _docstring(text, m.end())
                if found:
                    comments.append(_comment(found[0], found[1], found[2], index))
                    own_strings.add(found[1])
        elif kind == "string":
            line = text.rfind("\n", 0, m.start()) + 1
            if depth == 0 and header is None and m.start() not in own_strings and not text[line : m.start()].strip() and m[0][:1] in "\"'":
                comments.append(_comment(m[0].strip("\"'"), m.start(), m.end(), None))
        elif kind == "comment" and header is None:
            comments.append(_comment(_PY_MARK.sub("", m[0]).strip(), m.start(), m.end(), None))
    return functions, comments


def _python_parameters(header: str) -> list[str]:
    names = re.findall(r"(?:[(,]|^)\s*\*{0,2}(\w+)\s*(?=[:=,)]|$)", header)
    return [n for n in names if n not in ("self", "cls")]


def _comment(text: str, start: int, end: int, owner: int | None) -> Comment:
    tags = {a or b or c for a, b, c in _TAG.findall(text)} if ":" in text or "@" in text or "\\" in text else set()
    return Comment(text, start, end, owner, tags)


def scan_cpp(text: str) -> tuple[list[Function], list[Comment]]:
    """The unit's definition and its candidate comments; the block directly before it is its own."""
    lead = _CPP_LEAD.match(text).end()
    if _CLASS.match(text, lead):
        return [], []
    # Comments without a blank line between them are one; directly before: no blank line up to the definition.
    comments, blocks = [], []
    for m in _CPP_PIECE.finditer(text, 0, lead):
        if blocks and text.count("\n", blocks[-1][1], m.start()) < 2:
            blocks[-1][1] = m.end()
        else:
            blocks.append([m.start(), m.end()])
    for start, end in blocks:
        comments.append(_comment(clean_cpp(text[start:end]), start, end, 0 if text.count("\n", end, lead) < 2 else None))
    brace = text.find("{", lead)
    brace = len(text) if brace < 0 else brace
    m = re.compile(r"([~\w]+|operator\s*[^\s(]+)\s*\(").search(text, lead, brace)
    parameters = []
    if m:
        inner = text[m.end() : max(m.end(), text.rfind(")", m.end(), brace))]
        parameters = re.findall(r"(\w+)\s*(?:=[^,]*)?(?=,|$)", inner)
    functions = [Function(m[1] if m else "", parameters, lead, brace)]
    comments += [_comment(clean_cpp(c[1]), c.start(), c.end(), None) for c in _CPP_ITEM.finditer(text, lead) if c[1]]
    return functions, comments


def clean_cpp(comment: str) -> str:
    """A comment's text without its marks."""
    return _CPP_MARK.sub("", comment.replace("\r", "")).strip()


def describe(text: str | None, language: str) -> tuple[str, bool] | None:
    """The description of the unit's own function if it is documented in earnest, else None; and whether it stands
    where the language puts documentation (Python: its docstring; C++: directly before the definition)."""
    if not text or not text.strip():
        return None
    if language == PYTHON:
        if "def" not in text or ('"' not in text and "'" not in text and "#" not in text) or text.lstrip().startswith("class "):
            return None
        functions, comments = scan_python(text)
    else:
        if "//" not in text and "/*" not in text:
            return None
        functions, comments = scan_cpp(text)
    if not functions:
        return None
    own = link_comment(functions, comments)
    if own is None:
        return None
    found = comments[own]
    return None if is_trivial(found.text, functions[0].name, functions[0].parameters) else (found.text.strip(), found.owner == 0)


def _describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    warnings.simplefilter("ignore")
    for pdf in batches:
        out = pdf.drop(columns=["source_text"])
        got = [describe(t, PYTHON if (p or "").lower().endswith((".py", ".pyi")) else CPP) or (None, None) for t, p in zip(pdf["source_text"], pdf["path"])]
        out["description"] = [d for d, _ in got]
        out["in_place"] = pd.array([own for _, own in got], dtype="boolean")
        yield out.drop(columns=["path"])


def documented_functions(units: DataFrame, kinds: DataFrame) -> DataFrame:
    """(qualified_name, description, in_place) of the functions and methods documented in earnest.

    ``in_place`` tells the docstring or the comment directly before the definition
    from a comment that its tags and nearness link to the function.

    ``units``: qualified_name, path, source_text, version; ``kinds``:
    qualified_name, kind, version; other columns are ignored.  Per name the
    greatest version holds in both (null is oldest; ties: documented before not,
    then the greater description).  Names without a kind of function or method,
    null names, and null or empty texts give no rows.  Texts are read map-side, so
    only descriptions are shuffled; texts of classes are passed over.
    """
    read = units.where("qualified_name is not null").select("qualified_name", "path", "source_text", "version")
    schema = f"qualified_name string, version {dict(units.dtypes)['version']}, description string, in_place boolean"
    described = read.mapInPandas(_describe, schema)
    described = latest_by(described, ["qualified_name"], "version", ["description", "in_place"]).where("description is not null")
    kinds = latest_by(kinds.where("qualified_name is not null"), ["qualified_name"], "version", ["kind"])
    return described.join(kinds.where(F.col("kind").isin("function", "method")), "qualified_name", "left_semi")
