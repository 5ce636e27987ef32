"""Keyword queries: text to a tree of terms, phrases, prefixes and boolean operators.

Literal mode never fails: balanced quotes are phrases, every other run of characters is a
term, a trailing ``*`` makes a prefix, and upper-case AND, OR, NOT are operators only
between two terms. Juxtaposition binds tightest, then NOT, then AND, then OR.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_PIECE = re.compile(r'"([^"]*)"(\*?)|([^\s"]+)')
_TOKEN = re.compile(r"[^\W_]+")
OPERATORS = frozenset(("AND", "OR", "NOT"))


@dataclass(frozen=True)
class Term:
    tokens: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Node:
    kind: str  # all, and, or, not
    parts: tuple = field(default_factory=tuple)


def pieces(text: str) -> list[tuple[str, str]]:
    """(kind, text) of each piece that can match: term, or op between two terms."""
    raw: list[tuple[str, str]] = []
    for m in _PIECE.finditer(text):
        if m.group(3) is None:
            raw.append(("term", m.group(1) + m.group(2)))
        elif m.group(3) in OPERATORS:
            raw.append(("op", m.group(3)))
        else:
            raw.append(("term", m.group(3)))
    raw = [(k, t) for k, t in raw if k == "op" or _TOKEN.search(t)]
    out = []
    for n, (kind, t) in enumerate(raw):
        between = 0 < n < len(raw) - 1 and out and out[-1][0] == "term" and raw[n + 1][0] == "term"
        out.append((kind if kind == "term" or between else "term", t))
    return out


def literal(text: str) -> str:
    """The query with every term quoted, as an index with its own syntax would take it."""
    return " ".join(t if k == "op" else f'"{t[:-1]}"*' if t.endswith("*") and len(t) > 1 else f'"{t}"' for k, t in pieces(text))


def parse(text: str) -> Node | Term | None:
    """The tree of a query; None if nothing in it can match."""
    found = pieces(text)
    if not found:
        return None
    groups: list[list[Term]] = [[]]
    ops: list[str] = []
    for kind, t in found:
        if kind == "op":
            ops.append(t)
            groups.append([])
        else:
            prefix = t.endswith("*")
            groups[-1].append(Term(tuple(_TOKEN.findall(t.lower())), prefix))
    nodes: list = [g[0] if len(g) == 1 else Node("all", tuple(g)) for g in groups]
    for op, kind in (("NOT", "not"), ("AND", "and"), ("OR", "or")):
        n = 0
        while n < len(ops):
            if ops[n] == op:
                nodes[n : n + 2] = [Node(kind, (nodes[n], nodes[n + 1]))]
                ops.pop(n)
            else:
                n += 1
    return nodes[0]


def leaves(node) -> list[Term]:
    """Every term of the tree, in order, repeated ones too."""
    if node is None:
        return []
    return [node] if isinstance(node, Term) else [t for p in node.parts for t in leaves(p)]


# --- index syntax: columns, parentheses, NEAR, ^ -----------------------------------------


class QuerySyntaxError(ValueError):
    """The text is no query of the index syntax."""

    code = "fts_syntax"


@dataclass(frozen=True)
class Field:
    """A query asked of some columns only, or of all but some."""

    part: object
    columns: tuple[str, ...]
    other: bool = False


@dataclass(frozen=True)
class Near:
    """Phrases that stand within ``distance`` tokens of each other, in any order."""

    parts: tuple[Term, ...]
    distance: int = 10


@dataclass(frozen=True)
class First:
    """A phrase at the start of a column."""

    part: Term


_LEXEME = re.compile(r'\s*(?:("(?:[^"]|"")*")|([(){}:^*+,-])|([^\s"(){}:^*+,-]+))')


class _Syntax:
    """Recursive descent over the lexemes: or < and < not < juxtaposition < columns < phrase."""

    def __init__(self, text: str):
        self.items, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _LEXEME.match(text, at)
            if m is None:
                raise QuerySyntaxError(f"unbalanced quotes at {at}")
            self.items.append(m.group(1) or m.group(2) or m.group(3))
            at = m.end()
        self.at = 0

    def next_is(self, *what: str) -> bool:
        return self.at < len(self.items) and self.items[self.at] in what

    def take(self, what: str | None = None) -> str:
        if self.at >= len(self.items) or what is not None and self.items[self.at] != what:
            raise QuerySyntaxError(f"expected {what or 'a term'}")
        self.at += 1
        return self.items[self.at - 1]

    def whole(self):
        if not self.items:
            return None
        out = self.level("OR")
        if self.at < len(self.items):
            raise QuerySyntaxError(f"unexpected {self.items[self.at]}")
        return out

    def level(self, op: str):
        below = {"OR": "AND", "AND": "NOT"}.get(op)
        read = (lambda: self.level(below)) if below else self.row
        out = read()
        while self.next_is(op):
            self.take()
            out = Node(op.lower(), (out, read()))
        return out

    def row(self):
        parts = [self.piece()]
        while self.at < len(self.items) and not self.next_is("AND", "OR", "NOT", ")", ",", "}"):
            parts.append(self.piece())
        return parts[0] if len(parts) == 1 else Node("all", tuple(parts))

    def piece(self):
        other = self.next_is("-")
        if other:
            self.take()
        if self.next_is("{"):
            self.take()
            names = []
            while not self.next_is("}"):
                names.append(self.take())
            self.take("}")
            self.take(":")
            return Field(self.piece(), tuple(names), other)
        if self.at + 1 < len(self.items) and self.items[self.at + 1] == ":":
            name = self.take()
            self.take(":")
            return Field(self.piece(), (name,), other)
        if other:
            raise QuerySyntaxError("a minus stands before columns only")
        if self.next_is("("):
            self.take()
            out = self.level("OR")
            self.take(")")
            return out
        if self.next_is("^"):
            self.take()
            return First(self.phrase())
        if self.next_is("NEAR") and self.at + 1 < len(self.items) and self.items[self.at + 1] == "(":
            self.at += 2
            parts = [self.phrase()]
            while not self.next_is(",", ")"):
                parts.append(self.phrase())
            distance = 10
            if self.next_is(","):
                self.take()
                number = self.take()
                if not number.isdigit():
                    raise QuerySyntaxError("NEAR takes a number")
                distance = int(number)
            self.take(")")
            return Near(tuple(parts), distance)
        return self.phrase()

    def phrase(self) -> Term:
        tokens: list[str] = []
        while True:
            word = self.take()
            if word in OPERATORS or len(word) == 1 and not word.isalnum():
                raise QuerySyntaxError(f"unexpected {word}")
            tokens += _TOKEN.findall(word.lower())
            if not self.next_is("+"):
                break
            self.take()
        prefix = self.next_is("*")
        if prefix:
            self.take()
        if not tokens:
            raise QuerySyntaxError("a phrase needs a letter or digit")
        return Term(tuple(tokens), prefix)


def parse_syntax(text: str):
    """The tree of a query of the index syntax; hyphens inside words part them. Raises QuerySyntaxError."""
    return _Syntax(re.sub(r"(?<=\w)-(?=\w)", " ", text)).whole()


def leaves_of(node) -> list[Term]:
    """Every phrase of a tree of ``parse`` or ``parse_syntax``, in order."""
    if node is None:
        return []
    if isinstance(node, Term):
        return [node]
    if isinstance(node, Field | First):
        return leaves_of(node.part)
    return [t for p in node.parts for t in leaves_of(p)]
