"""Symbols of C++ files: namespaces, classes and function definitions, found by matching braces."""

from __future__ import annotations

import posixpath
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, name string, qualified_name string, kind string, start_line int, end_line int, start_byte int, end_byte int, signature string, parent string"
_SKIP = re.compile(r"(?s)//(?:\\\n|[^\n])*|/\*.*?\*/|R\"(?P<d>[^()\\\s]{0,16})\(.*?\)(?P=d)\"|\"(?:\\.|[^\"\\\n])*\"|(?<![0-9A-Za-z])'(?:\\.|[^'\\\n])+'|^[ \t]*\#(?:\\\n|[^\n])*", re.M)
_NAMESPACE = re.compile(r"(?s)^\s*(?:inline\s+)?namespace\s*([\w:]*)\s*$")
_CLASS = re.compile(r"(?s)^\s*(?:\[\[.*?\]\]\s*)?(class|struct)\s+([\w:]+)(?:\s+final)?\s*(?::(?!:).*)?$")
_FUNCTION = re.compile(r"(?s)((?:[\w~]+\s*(?:<[^<>]*>)?\s*::\s*)*(?:operator\s*(?:\(\s*\)|[^\s\w(]+|\w[\w\s:*&]*)|~?\w+))\s*\(")
_NOT_FUNCTION = re.compile(r"^\s*(?:if|for|while|switch|catch|return|else|do|try|enum|union|template|using|typedef|extern\s+\"C\")\b|=\s*(?:\[|\{|$)")


def _blank(text: str) -> str:
    """Comments, literals and directives replaced by blanks of equal length."""
    return _SKIP.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def canonical_parameters(text: str) -> str:
    """Parameter types without names and default values, ``*`` and ``&`` on the type."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text + ","):
        depth += (c in "(<[{") - (c in ")>]}")
        if c == "," and depth <= 0:
            parts.append(text[start:i])
            start, depth = i + 1, 0
    out = []
    for p in parts:
        p = re.sub(r"\s+", " ", p.split("=")[0]).strip()
        if not p or p == "void":
            continue
        array = "[]" if p.endswith("]") else ""
        p = re.sub(r"\s*\[[^\]]*\]$", "", p)
        m = re.match(r"^(.*[\w>*&])[\s*&]*?\b(\w+)$", p)
        if m and re.sub(r"\b(?:const|volatile|unsigned|signed|long|short|typename)\b|[\s*&]", "", p[: m.start(2)]):
            p = p[: m.start(2)]
        elif m and m[2] not in ("int", "long", "short", "char", "double", "float", "bool", "unsigned", "signed", "auto") and re.search(r"\b(?:unsigned|signed|long|short)\b", p[: m.start(2)]):
            p = p[: m.start(2)]
        out.append(re.sub(r"\s*([*&]+)\s*", r"\1", p).strip() + array)
    return ", ".join(out)


def symbols_of(path: str, text: str) -> list[tuple]:
    """The file's module and its symbols in source order; the first of several equal names is kept."""
    plain = _blank(text)
    line_of = [0]
    for m in re.finditer("\n", text):
        line_of.append(m.end())
    encoded = len(text.encode("utf-8", "replace")) != len(text)

    def place(at: int) -> tuple[int, int]:
        lo, hi = 0, len(line_of)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if line_of[mid] <= at else (lo, mid)
        return lo + 1, len(text[:at].encode("utf-8", "replace")) if encoded else at

    module = f"@file:{path}"
    out = [(path, path.rpartition("/")[2], module, "module", 1, len(line_of), 0, len(text.encode("utf-8", "replace")), None, None)]
    seen, classes = {module}, set()
    ordinal = 0
    # (kind, semantic scope, parent symbol, index in out or None)
    stack: list[tuple[str, str, str, int | None]] = [("file", "", module, None)]
    start, depth = 0, 0
    for m in re.finditer(r"[{};()]|\b(?:public|private|protected)\s*:(?!:)", plain):
        c = m[0]
        if c in "()":
            depth += 1 if c == "(" else -1
            continue
        if depth > 0:
            continue
        if c == "{":
            head = plain[start : m.start()]
            kind, scope, parent, _ = stack[-1]
            entry: tuple[str, str, str, int | None] = ("block", scope, parent, None)
            if kind in ("file", "namespace", "class"):
                at = start + len(head) - len(head.lstrip())
                n, k = _NAMESPACE.match(head), _CLASS.match(head)
                if n:
                    inner = "::".join(x for x in (scope, n[1] or "<anonymous>") if x)
                    name = f"@namespace:{path}:{ordinal}:{inner}"
                    ordinal += 1
                    out.append((path, inner.rpartition("::")[2], name, "namespace", *place(at), 0, 0, None, parent))
                    entry = ("namespace", inner, name, len(out) - 1)
                elif k:
                    inner = "::".join(x for x in (scope, k[2]) if x)
                    out.append((path, k[2].rpartition("::")[2], inner, "class", *place(at), 0, 0, text[at : m.start()].rstrip(), parent))
                    classes.add(inner)
                    entry = ("class", inner, inner, len(out) - 1)
                elif not _NOT_FUNCTION.search(head) and (f := _FUNCTION.search(head)):
                    name = re.sub(r"\s+", "", f[1]) if not f[1].startswith("operator") else f[1]
                    close, level = f.end(), 1
                    while close < len(head) and level:
                        level += (head[close] == "(") - (head[close] == ")")
                        close += 1
                    tail = re.split(r"(?<!:):(?!:)|->", head[close:])[0]
                    quals = "".join(f" {q}" for q in re.findall(r"\bconst\b|\bvolatile\b|&&|&", tail))
                    local = "@filelocal:" + path + "::" if re.search(r"\bstatic\b", head[: f.start()]) and kind != "class" or "<anonymous>" in scope else ""
                    qualified = local + "::".join(x for x in (scope, name) if x) + f"({canonical_parameters(head[f.end() : close - 1])}){quals}"
                    owner = "::".join(x for x in (scope, name.rpartition("::")[0]) if x)
                    method = kind == "class" or ("::" in name and owner in classes)
                    if qualified not in seen:
                        seen.add(qualified)
                        out.append((path, name.rpartition("::")[2], qualified, "method" if method else "function", *place(at), 0, 0, text[at : m.start()].rstrip(), owner if method and kind != "class" else parent))
                        entry = ("function", scope, parent, len(out) - 1)
            stack.append(entry)
            start = m.end()
        elif c == "}":
            start = m.end()
            if len(stack) > 1:
                index = stack.pop()[3]
                if index is not None:
                    end_line, end_byte = place(m.end())
                    row = out[index]
                    out[index] = (*row[:4], row[4], end_line, row[5], end_byte, *row[8:])
        else:
            start = m.end()
    return [r for i, r in enumerate(out) if i == 0 or r[7] > 0]


def cpp_symbols(files: DataFrame) -> DataFrame:
    """Module, namespaces, classes and defined functions of (path, content); unclosed ones are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for pdf in batches:
            rows = [row for path, text in zip(pdf["path"], pdf["content"]) for row in symbols_of(path, text.replace("\r\n", "\n"))]
            yield pd.DataFrame(rows, columns=columns)

    return files.where("path is not null and content is not null").select("path", "content").mapInPandas(run, SCHEMA)


FACTS = "path string, kind string, source string, target_text string, form string, scope string, candidates array<string>, start_line int, end_line int, start_byte int, end_byte int"
_CALL = re.compile(r"(?:(?P<this>\bthis\s*->\s*)|(?P<field>[\w)\]]\s*(?:\.|->)\s*))?(?P<name>(?:::\s*)?(?:\w+\s*::\s*)*~?\b[A-Za-z_]\w*)\s*\(")
_NO_CALL = frozenset(
    """if for while switch return catch sizeof alignof decltype noexcept typeid static_cast dynamic_cast const_cast reinterpret_cast static_assert throw new delete else do case co_await
    co_return co_yield operator alignas requires defined int long short char bool float double void unsigned signed auto""".split()
)
_BEFORE_CALL = frozenset("return else do case throw new delete co_return co_yield co_await and or not typename template".split())
_LOCAL = re.compile(r"(?:\b(?:auto|int|long|short|char|bool|float|double|unsigned|signed|[A-Za-z_][\w:]*(?:<[^<>;(){}]*>)?)\b[\s*&]+(?:const\s+)?)([A-Za-z_]\w*)\s*(?=[=;{,)]|\()")


_BASE = re.compile(r"(?:\s|(?:public|private|protected|virtual)\b)*")


def _split_at_commas(text: str) -> list[tuple[int, int]]:
    """Spans between the commas that stand outside of brackets."""
    spans, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "(<[{") - (c in ")>]}")
        if c == "," and depth <= 0:
            spans.append((start, i))
            start = i + 1
    return [*spans, (start, len(text))]


def _without_file(name: str) -> str:
    return name.split("::", 1)[1] if name.startswith("@filelocal:") else name


def facts_of(path: str, text: str) -> list[tuple]:
    """Includes, base classes and calls of a file, with the scope they are looked up from.

    form: ``include`` (candidates are the files that may be meant), ``system``,
    ``base``, ``bare``, ``qualified``, ``this``, ``field`` (a member of an object),
    ``local`` (a local name hides the function) or ``template``.
    """
    # One character per byte, so that positions are byte offsets.
    data = text.encode("utf-8", "replace").decode("latin-1")
    plain = _blank(data)
    rows = symbols_of(path, text)
    module = rows[0][2]
    starts = [0, *[m.end() for m in re.finditer("\n", data)]]

    def line(at: int) -> int:
        return bisect_right(starts, at)

    out: list[tuple] = []

    def emit(kind: str, source: str, shown: str, form: str, scope: str, a: int, b: int, candidates: list[str] | None = None) -> None:
        shown = shown.encode("latin-1").decode("utf-8", "replace")
        out.append((path, kind, source, shown, form, scope, candidates or [], line(a), line(max(a, b - 1)), a, b))

    folder = path.rpartition("/")[0]
    commented = re.sub(r"(?s)//[^\n]*|/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), data)
    for m in re.finditer(r"(?m)^[ \t]*\#[ \t]*include[ \t]*(\"[^\"\n]+\"|<[^>\n]+>)", commented):
        if m[1].startswith("<"):
            emit("imports", module, m[1], "system", "", m.start(1), m.end(1))
        else:
            near = posixpath.normpath(posixpath.join(folder, m[1][1:-1]))
            emit("imports", module, m[1], "include", "", m.start(1), m.end(1), sorted({f"@file:{near}", f"@file:{posixpath.normpath(m[1][1:-1])}"}))
    functions = sorted((r[6], r[7], r) for r in rows if r[3] in ("function", "method"))
    for r in rows:
        if r[3] == "class":
            head = plain[r[6] : plain.index("{", r[6])]
            bases = re.split(r"(?<!:):(?!:)", head, maxsplit=1)
            if len(bases) == 2:
                at = r[6] + len(bases[0]) + 1
                for first, last in _split_at_commas(bases[1]):
                    m = _BASE.match(bases[1], first, last)
                    name = bases[1][m.end() : last].rstrip()
                    if name:
                        a = at + m.end()
                        emit("inherits", r[2], name, "template" if "<" in name else "base", r[2].rpartition("::")[0], a, a + len(name))
    for a, b, r in functions:
        body = plain.index("{", a) if "{" in plain[a:b] else b
        inner = [(x, y) for x, y, _ in functions if a < x and y <= b]
        stem = re.sub(r"\(.*$", "", _without_file(r[2]))
        scope = stem.rpartition("::")[0]
        hidden = {m[1]: m.start(1) for m in reversed(list(_LOCAL.finditer(plain, plain.find("(", a, b), b)))}
        for m in _CALL.finditer(plain, body, b):
            name = re.sub(r"\s+", "", m["name"])
            if name in _NO_CALL or any(x <= m.start() < y for x, y in inner):
                continue
            before = re.search(r"([\w>]+)\s+$|([*&>])\s*$", plain[max(body, m.start() - 80) : m.start("name")])
            if not m["this"] and not m["field"] and before and before[1] and before[1] not in _BEFORE_CALL:
                continue  # a declaration with an initialiser
            form = "this" if m["this"] else "field" if m["field"] else "qualified" if "::" in name else "local" if hidden.get(name, b) < m.start("name") else "bare"
            emit("calls", r[2], name, form, scope, m.start("this") if m["this"] else m.start("name"), m.end("name"))
    return out


def cpp_facts(files: DataFrame) -> DataFrame:
    """Facts of (path, content); see :func:`facts_of`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in FACTS.split(", ")]
        for pdf in batches:
            rows = [row for path, text in zip(pdf["path"], pdf["content"]) for row in facts_of(path, text.replace("\r\n", "\n"))]
            yield pd.DataFrame(rows, columns=columns)

    return files.where("path is not null and content is not null").select("path", "content").mapInPandas(run, FACTS)


def resolve_cpp(facts: DataFrame, symbols: DataFrame) -> DataFrame:
    """Facts with target and resolution.

    An include is resolved if exactly one candidate file is indexed.  Plain names
    are looked up scope by scope, innermost first, and resolved if the first
    scope with a match has one (overloads stay unresolved); a method of a unique
    class, or of ``this``, is probable.  Members of objects, system headers,
    template bases and names hidden by locals stay unresolved.
    """
    facts = facts.withColumn("fact_id", F.xxhash64("path", "kind", "source", "start_byte", "end_byte", "target_text"))
    stem = F.regexp_replace(F.regexp_replace("qualified_name", r"^@filelocal:.*?::", ""), r"\(.*$", "")
    known = symbols.where(F.col("kind").isin("class", "function", "method")).select(stem.alias("candidate"), "qualified_name", "kind")
    known = known.groupBy("candidate", F.when(F.col("kind") == "class", "class").otherwise("callable").alias("sort")).agg(
        F.count(F.lit(1)).alias("n_found"), F.min("qualified_name").alias("found"), F.min("kind").alias("found_kind")
    )
    modules = symbols.where("kind = 'module'").select(F.col("qualified_name").alias("file")).distinct()
    included = facts.where("form = 'include'").select("fact_id", F.explode("candidates").alias("file")).join(modules, "file").groupBy("fact_id").agg(F.count(F.lit(1)).alias("n_found"), F.min("file").alias("found"))
    included = included.select("fact_id", F.when(F.col("n_found") == 1, F.col("found")).alias("target"), F.when(F.col("n_found") == 1, "resolved").alias("status"))

    looked = facts.where(F.col("form").isin("base", "bare", "qualified", "this"))
    parts = F.split("scope", "::")
    levels = F.when(F.col("form") == "this", F.array(F.col("scope"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(parts)), lambda depth: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - depth), "::"))
    )
    walked = looked.select("fact_id", "form", "kind", F.regexp_replace("target_text", "^::", "").alias("name"), F.posexplode(levels).alias("depth", "level"))
    walked = walked.withColumn("candidate", F.concat_ws("::", F.when(F.col("level") != "", F.col("level")), "name")).withColumn("sort", F.when(F.col("kind") == "inherits", "class").otherwise("callable"))
    first = walked.join(known, ["candidate", "sort"]).groupBy("fact_id").agg(F.min(F.struct("depth", "n_found", "found", "found_kind", "form")).alias("f"))
    unique = F.col("f.n_found") == 1
    status = F.when((F.col("f.form") == "this") | ((F.col("f.form") == "qualified") & (F.col("f.found_kind") == "method")), "probable").otherwise("resolved")
    named = first.select("fact_id", F.when(unique, F.col("f.found")).alias("target"), F.when(unique, status).alias("status"))
    verdict = included.unionAll(named)
    out = facts.join(verdict, "fact_id", "left")
    return out.select("path", "kind", "source", "target", "target_text", F.coalesce("status", F.lit("unresolved")).alias("resolution"), "start_line", "end_line", "start_byte", "end_byte").distinct()
