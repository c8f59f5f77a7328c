"""Recognising token streams with memoised derivatives of a grammar.

A language is a set of sequences of grammar expressions still to be read.  Its
derivative by a token is the set of what remains after that token: each
expression has memoised partial derivatives (the sequences that may follow the
token), sequences are shared cells with memoised derivatives, and whole languages
are interned with a table of their derivatives, so text that looks alike costs one
lookup a token.  An empty derivative marks the failing token; a language at the
end that does not hold the empty sequence means that the text breaks off.

Grammars are given as rules in EBNF: ``name: a 'token' | [optional] (group)* b+``.
Rules must not be left-recursive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_LEXEME = re.compile(r"\s*(?:(?P<rule>\w+)\s*:(?=\s)|'(?P<token>[^']+)'|(?P<name>\w+)|(?P<mark>[()\[\]|*+]))")
MAX_CELLS = 400_000


@dataclass
class Tokens:
    """Token classes of a text.

    ``end`` is the number of those that stand in the text (behind it are what its end adds), ``cut`` tells that
    the text ends within a token or an open conditional, ``readings`` are the parts to be read as one text each, as
    spans of tokens; None: the whole.
    """

    classes: list[str]
    end: int | None = None
    cut: bool = False
    readings: list[list[tuple[int, int]]] | None = None


class Grammar:
    """Expressions are numbered tuples: ('tok', t), ('seq', a, b), ('alt', ...), ('star', a), ('ref', name), ('eps',)."""

    def __init__(self, rules: str, start: str):
        self.nodes: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.rules: dict[str, int] = {}
        self.eps = self.node(("eps",))
        for name, body in self._read(rules):
            self.rules[name] = body
        for node in self.nodes:
            if node[0] == "ref" and node[1] not in self.rules:
                raise ValueError(f"no rule {node[1]}")
        self.nullable = self._nullable()
        self.start = self.node(("ref", start))
        self.nullable.append(self.nullable[self.rules[start]]) if len(self.nullable) < len(self.nodes) else None
        self.reset()

    def node(self, expression: tuple) -> int:
        if expression not in self.numbers:
            self.numbers[expression] = len(self.nodes)
            self.nodes.append(expression)
        return self.numbers[expression]

    def _read(self, text: str):
        lexemes = [(m.lastgroup, m[m.lastgroup]) for m in _LEXEME.finditer(text)]
        at = 0

        def alternatives() -> int:
            nonlocal at
            found = [sequence()]
            while at < len(lexemes) and lexemes[at] == ("mark", "|"):
                at += 1
                found.append(sequence())
            return found[0] if len(found) == 1 else self.node(("alt", *found))

        def sequence() -> int:
            nonlocal at
            items = []
            while at < len(lexemes) and lexemes[at][0] != "rule" and lexemes[at] not in (("mark", "|"), ("mark", ")"), ("mark", "]")):
                kind, value = lexemes[at]
                at += 1
                if value == "(" and kind == "mark":
                    item = alternatives()
                    at += 1
                elif value == "[" and kind == "mark":
                    item = self.node(("alt", alternatives(), self.eps))
                    at += 1
                else:
                    item = self.node(("tok" if kind == "token" or value.isupper() else "ref", value))
                while at < len(lexemes) and lexemes[at] in (("mark", "*"), ("mark", "+")):
                    star = self.node(("star", item))
                    item = star if lexemes[at][1] == "*" else self.node(("seq", item, star))
                    at += 1
                items.append(item)
            out = self.eps if not items else items[-1]
            for item in reversed(items[:-1]):
                out = self.node(("seq", item, out))
            return out

        while at < len(lexemes):
            name = lexemes[at][1]
            at += 1
            yield name, alternatives()

    def _nullable(self) -> list[bool]:
        known = [False] * len(self.nodes)
        changed = True
        while changed:
            changed = False
            for i, node in enumerate(self.nodes):
                if not known[i]:
                    kind = node[0]
                    known[i] = (
                        kind in ("eps", "star")
                        or (kind == "seq" and known[node[1]] and known[node[2]])
                        or (kind == "alt" and any(known[x] for x in node[1:]))
                        or (kind == "ref" and known[self.rules[node[1]]])
                    )
                    changed |= known[i]
        return known

    def reset(self) -> None:
        """Forget all memoised derivatives; the grammar stays."""
        self.partials: dict[tuple[int, str], tuple[tuple[int, ...], ...]] = {}
        self.cells: dict[tuple[int, int], int] = {}
        self.head, self.rest = [-1], [0]  # cell 0: nothing left to read
        self.cell_nullable = [True]
        self.cell_memo: dict[tuple[int, str], frozenset[int]] = {}
        self.languages: dict[frozenset[int], int] = {}
        self.members: list[frozenset[int]] = []
        self.accepts: list[bool] = []
        self.table: list[dict[str, int]] = []
        self.empty = self._language(frozenset())
        self.first = self._language(frozenset([self._cell(self.start, 0)]))

    def _cell(self, node: int, rest: int) -> int:
        key = (node, rest)
        cell = self.cells.get(key)
        if cell is None:
            cell = self.cells[key] = len(self.head)
            self.head.append(node)
            self.rest.append(rest)
            self.cell_nullable.append(self.nullable[node] and self.cell_nullable[rest])
        return cell

    def _language(self, cells: frozenset[int]) -> int:
        number = self.languages.get(cells)
        if number is None:
            number = self.languages[cells] = len(self.members)
            self.members.append(cells)
            self.accepts.append(any(self.cell_nullable[c] for c in cells))
            self.table.append({})
        return number

    def partial(self, node: int, token: str) -> tuple[tuple[int, ...], ...]:
        """What may remain of ``node`` after ``token``, as sequences of expressions."""
        key = (node, token)
        got = self.partials.get(key)
        if got is None:
            expression = self.nodes[node]
            kind = expression[0]
            found: dict[tuple[int, ...], None] = {}
            if kind == "tok":
                if expression[1] == token:
                    found[()] = None
            elif kind == "seq":
                _, a, b = expression
                for x in self.partial(a, token):
                    found[(*x, b)] = None
                if self.nullable[a]:
                    found |= dict.fromkeys(self.partial(b, token))
            elif kind == "alt":
                for a in expression[1:]:
                    found |= dict.fromkeys(self.partial(a, token))
            elif kind == "star":
                for x in self.partial(expression[1], token):
                    found[(*x, node)] = None
            elif kind == "ref":
                found = dict.fromkeys(self.partial(self.rules[expression[1]], token))
            got = self.partials[key] = tuple(found)
        return got

    def _derive_cell(self, cell: int, token: str) -> frozenset[int]:
        key = (cell, token)
        got = self.cell_memo.get(key)
        if got is None:
            out, at = set(), cell
            while at:
                rest = self.rest[at]
                for sequence in self.partial(self.head[at], token):
                    new = rest
                    for node in reversed(sequence):
                        new = self._cell(node, new)
                    out.add(new)
                if not self.nullable[self.head[at]]:
                    break
                at = rest
            got = self.cell_memo[key] = frozenset(out)
        return got

    def derive(self, language: int, token: str) -> int:
        """The language after ``token``."""
        got = self.table[language].get(token)
        if got is None:
            cells: set[int] = set()
            for cell in self.members[language]:
                cells |= self._derive_cell(cell, token)
            got = self.table[language][token] = self._language(frozenset(cells))
        return got

    def failure(self, tokens: list[str]) -> int | None:
        """None if the grammar has ``tokens``; else the index of the failing one, or their number if they break off."""
        if len(self.head) > MAX_CELLS or len(self.members) > MAX_CELLS:
            self.reset()
        language, table, empty = self.first, self.table, self.empty
        for i, token in enumerate(tokens):
            after = table[language].get(token)
            if after is None:
                after = self.derive(language, token)
            if after == empty:
                return i
            language = after
        return None if self.accepts[language] else len(tokens)

    def verdict(self, text: Tokens) -> tuple[bool, int | None]:
        """(truncated, failing): (False, None) if every reading is of the language, else the first token with an empty
        derivative or, where no token fails but the text breaks off, the number of its tokens."""
        end = len(text.classes) if text.end is None else text.end
        least = end if text.cut else None
        for spans in text.readings or [[(0, len(text.classes))]]:
            at = self.failure([c for a, b in spans for c in text.classes[a:b]] if text.readings else text.classes)
            for a, b in spans:
                if at is None or at < b - a:
                    at = None if at is None else a + at
                    break
                at -= b - a
            else:
                at = end
            if at is not None:
                least = min(at, end if least is None else least)
        return least == end and least is not None, least
