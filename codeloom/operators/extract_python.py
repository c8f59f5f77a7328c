"""Symbols and reference facts of Python files, one small reading per file; names are resolved by joins."""

from __future__ import annotations

import ast
import io
import tokenize
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "path string, name string, qualified_name string, kind string, start_line int, end_line int, start_byte int, end_byte int, signature string, parent string, source_text string, has_syntax_errors boolean"
FACTS = "path string, kind string, source string, target_text string, candidate string, owner string, start_line int, end_line int, start_byte int, end_byte int"
LOCAL = ""
_DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def module_name(path: str) -> str:
    """Dotted module of a relative path; a package is named by its folder, a root package by itself."""
    parts = path.removesuffix(".py").removesuffix(".PY").split("/")
    if len(parts) > 1 and parts[-1] == "__init__":
        parts.pop()
    return ".".join(parts)


class Source:
    def __init__(self, path: str, text: str):
        self.path, self.module = path, module_name(path)
        self.data = text.encode("utf-8", "replace")
        self.starts = [0]
        for line in self.data.splitlines(keepends=True):
            self.starts.append(self.starts[-1] + len(line))
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                self.tree: ast.Module | None = ast.parse(self.data)
        except (SyntaxError, ValueError, RecursionError):
            self.tree = None
        self.comments: dict[int, int] = {}
        if self.tree is not None and b"#" in self.data:
            try:
                for t in tokenize.tokenize(io.BytesIO(self.data).readline):
                    if t.type == tokenize.COMMENT:
                        self.comments[t.start[0]] = self.starts[t.start[0] - 1] + len(t.line[: t.start[1]].encode()) + len(t.string.encode())
            except (tokenize.TokenError, SyntaxError):
                pass

    def byte(self, line: int, column: int) -> int:
        return self.starts[line - 1] + column

    def span(self, node: ast.AST) -> tuple[int, int, int, int]:
        """Lines and bytes of a node; decorators and a comment behind the last statement belong to a definition."""
        line, column = node.lineno, node.col_offset
        if isinstance(node, _DEFINITIONS) and node.decorator_list:
            first = node.decorator_list[0]
            line = first.lineno
            column = self.data.rindex(b"@", self.starts[line - 1], self.byte(line, first.col_offset)) - self.starts[line - 1]
        end = self.byte(node.end_lineno, node.end_col_offset)
        if isinstance(node, _DEFINITIONS):
            end = max(end, self.comments.get(node.end_lineno, 0))
        return line, node.end_lineno, self.byte(line, column), end

    def text(self, start: int, end: int) -> str:
        return self.data[start:end].decode("utf-8", "replace")

    def signature(self, node: ast.AST) -> str:
        body = node.body[0]
        line, column = body.lineno, body.col_offset
        if isinstance(body, _DEFINITIONS) and body.decorator_list:
            line, column = body.decorator_list[0].lineno, body.decorator_list[0].col_offset - 1
        head = self.text(self.byte(node.lineno, node.col_offset), self.byte(line, column)).rstrip()
        return head.removesuffix(":").rstrip()


def _nested(node: ast.AST) -> Iterator[ast.AST]:
    """Definitions of a scope, also those within its plain statements."""
    for child in ast.iter_child_nodes(node):
        if isinstance(child, _DEFINITIONS):
            yield child
        elif not isinstance(child, ast.expr):
            yield from _nested(child)


def symbols_of(path: str, text: str) -> list[tuple]:
    src = Source(path, text)
    end_line = max(1, len(src.starts) - 1)
    base = src.module.rpartition(".")[2]
    out = [(path, base, src.module, "module", 1, end_line, 0, len(src.data), None, None, None, src.tree is None)]

    def visit(node: ast.AST, parent: str, in_class: bool) -> None:
        for d in _nested(node):
            name = f"{parent}.{d.name}"
            kind = "class" if isinstance(d, ast.ClassDef) else "method" if in_class else "function"
            span = src.span(d)
            out.append((path, d.name, name, kind, *span, src.signature(d), parent, src.text(span[2], span[3]), False))
            visit(d, name, kind == "class")

    if src.tree is not None:
        visit(src.tree, src.module, False)
    return out


class Scope:
    def __init__(self, name: str, kind: str, outer: Scope | None):
        self.name, self.kind, self.outer = name, kind, outer
        self.names: dict[str, str] = {}

    def lookup(self, name: str) -> str | None:
        """The qualified name that ``name`` means here, LOCAL for a local value, None if unknown.

        Enclosing class scopes are skipped when looking out of a function.
        """
        scope: Scope | None = self
        from_function = self.kind != "class"
        while scope is not None:
            if name in scope.names and not (scope is not self and scope.kind == "class" and from_function):
                return scope.names[name]
            scope = scope.outer
        return None


def facts_of(path: str, text: str) -> list[tuple]:
    """(path, kind, source, target_text, candidate, owner, span): imports, calls, base classes and uses of names.

    candidate is the qualified name that would be meant; owner is the name before
    the dot where a member of it is meant.  Whether they exist is left to a join.
    """
    src = Source(path, text)
    if src.tree is None:
        return []
    out: list[tuple] = []
    package = src.module.split(".") if path.endswith("__init__.py") else src.module.split(".")[:-1]

    def emit(kind: str, source: str, shown: str, node: ast.AST, candidate: str | None, owner: str | None = None) -> None:
        line, end, a, b = src.span(node)
        out.append((path, kind, source, shown, candidate or None, owner, line, end, a, b))

    def base_module(node: ast.ImportFrom) -> str | None:
        if not node.level:
            return node.module
        if node.level - 1 > len(package):
            return None
        return ".".join([*package[: len(package) - node.level + 1], *([node.module] if node.module else [])])

    def collect(body: list[ast.stmt], scope: Scope) -> None:
        for node in body:
            if isinstance(node, _DEFINITIONS):
                continue
            if isinstance(node, ast.Import):
                for a in node.names:
                    scope.names[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
            elif isinstance(node, ast.ImportFrom):
                module = base_module(node)
                for a in node.names:
                    if a.name != "*" and module is not None:
                        scope.names[a.asname or a.name] = f"{module}.{a.name}" if module else a.name
            elif isinstance(node, (ast.Assign, ast.AnnAssign, ast.For, ast.AsyncFor)):
                for target in node.targets[:1] if isinstance(node, ast.Assign) else [node.target]:
                    for x in ast.walk(target):
                        if isinstance(x, ast.Name):
                            scope.names[x.id] = LOCAL
                        elif isinstance(x, ast.Attribute) and isinstance(x.value, ast.Name):
                            scope.names[x.attr] = LOCAL
            for field in ("body", "orelse", "finalbody"):
                collect([x for x in getattr(node, field, []) if isinstance(x, ast.stmt)], scope)
            for part in [*getattr(node, "handlers", []), *getattr(node, "cases", [])]:
                collect(part.body, scope)

    def meant(node: ast.expr, scope: Scope) -> tuple[str | None, str | None]:
        if isinstance(node, ast.Name):
            return scope.lookup(node.id) or None, None
        if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name):
            if node.value.id in ("self", "cls"):
                s: Scope | None = scope
                while s is not None and s.kind != "class":
                    s = s.outer
                if s is not None:
                    return f"{s.name}.{node.attr}", s.name
            owner = scope.lookup(node.value.id)
            if owner:
                return f"{owner}.{node.attr}", owner
        return None, None

    def expression(node: ast.AST, scope: Scope) -> None:
        if isinstance(node, ast.Call):
            candidate, owner = meant(node.func, scope)
            emit("calls", scope.name, ast.unparse(node.func), node.func, candidate, owner)
        elif isinstance(node, (ast.Name, ast.Attribute)) and isinstance(node.ctx, ast.Load):
            candidate, owner = meant(node, scope)
            if candidate:
                emit("references", scope.name, ast.unparse(node), node, candidate, owner)
            elif isinstance(node, ast.Attribute):
                expression(node.value, scope)
        elif not isinstance(node, (*_DEFINITIONS, ast.Lambda)):
            for child in ast.iter_child_nodes(node):
                if not isinstance(child, ast.stmt):
                    expression(child, scope)

    def statements(body: list[ast.stmt], scope: Scope) -> None:
        for node in body:
            if isinstance(node, _DEFINITIONS):
                kind = "class" if isinstance(node, ast.ClassDef) else "function"
                inner = Scope(f"{scope.name}.{node.name}", kind, scope)
                if isinstance(node, ast.ClassDef):
                    for b in [*node.bases, *node.keywords]:
                        value = b.value if isinstance(b, ast.keyword) else b
                        candidate, owner = (None, None) if isinstance(b, ast.keyword) else meant(value, scope)
                        emit("inherits", inner.name, ast.unparse(b), value, candidate, owner)
                else:
                    a = node.args
                    for p in [*a.posonlyargs, *a.args, *a.kwonlyargs, *([a.vararg] if a.vararg else []), *([a.kwarg] if a.kwarg else [])]:
                        inner.names[p.arg] = LOCAL
                inner.names |= {d.name: f"{inner.name}.{d.name}" for d in _nested(node)}
                collect(node.body, inner)
                statements(node.body, inner)
            elif isinstance(node, ast.Import):
                for x in node.names:
                    emit("imports", src.module, x.name, node, x.name)
            elif isinstance(node, ast.ImportFrom):
                module, dots = base_module(node), "." * node.level
                for x in node.names:
                    shown = f"{dots}{node.module + '.' if node.module else ''}{x.name}"
                    emit("imports", src.module, shown, node, None if module is None or x.name == "*" else f"{module}.{x.name}" if module else x.name)
            else:
                for child in ast.iter_child_nodes(node):
                    if isinstance(child, ast.stmt) or child is getattr(node, "annotation", None):
                        continue
                    if isinstance(child, (ast.ExceptHandler, ast.match_case)):
                        statements(child.body, scope)
                    else:
                        expression(child, scope)
                for field in ("body", "orelse", "finalbody"):
                    statements([x for x in getattr(node, field, []) if isinstance(x, ast.stmt)], scope)

    top = Scope(src.module, "module", None)
    top.names |= {d.name: f"{src.module}.{d.name}" for d in _nested(src.tree)}
    collect(src.tree.body, top)
    statements(src.tree.body, top)
    return out


def _rows(extract, schema: str):
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [row for path, text in zip(pdf["path"], pdf["content"]) for row in extract(path, text)]
            yield pd.DataFrame(rows, columns=columns)

    return run


def python_symbols(files: DataFrame) -> DataFrame:
    """Module, classes, functions and methods of (path, content); a file that does not parse keeps its module, flagged."""
    return files.where("path is not null and content is not null").select("path", "content").mapInPandas(_rows(symbols_of, SYMBOLS), SYMBOLS)


def python_facts(files: DataFrame) -> DataFrame:
    return files.where("path is not null and content is not null").select("path", "content").mapInPandas(_rows(facts_of, FACTS), FACTS)


def resolve_python(facts: DataFrame, symbols: DataFrame) -> DataFrame:
    """Facts with target and resolution: resolved if the meant name exists, probable for a member of a class.

    Base classes must be classes; uses that resolve to nothing are dropped.
    """
    names = symbols.groupBy("qualified_name").agg(F.min("kind").alias("found_kind"))
    owners = names.select(F.col("qualified_name").alias("owner"), F.col("found_kind").alias("owner_kind"))
    joined = facts.join(names.withColumnRenamed("qualified_name", "candidate"), "candidate", "left").join(owners, "owner", "left")
    exists = F.col("found_kind").isNotNull() & ((F.col("kind") != "inherits") | (F.col("found_kind") == "class"))
    status = F.when(~exists, "unresolved").when(F.col("owner_kind") == "class", "probable").otherwise("resolved")
    out = joined.withColumn("resolution", status).where((F.col("kind") != "references") | (F.col("resolution") != "unresolved"))
    return out.select("path", "kind", "source", F.when(exists, F.col("candidate")).alias("target"), "target_text", "resolution", "start_line", "end_line", "start_byte", "end_byte").distinct()
