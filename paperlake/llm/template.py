"""Templates of same-host pages: equivalence classes of tokens with equal occurrence vectors.

A page is one record's text; pages of one host (a bibliography file, a converter) repeat the
same markup around differing words. A text is lexed into sign tokens (tags, commands,
references, runs of signs); words are what fills the slots. A token that can open as well as
close is told apart by its role, the side on which a word stands.

A token's occurrence vector holds its count on every page of the host. Two tokens are
equivalent if their vectors agree, in turns of first and second, on at least ``share`` of the
pages that hold either, and on ``support`` pages: pages are noisy, so vectors needn't be
equal everywhere. The same is asked over all hosts together, for hosts of few pages. Valid
classes nest: on a page, spans from a first to a second token are matched with a stack, and
the path of the spans around one is its place in the template. A token of enough pages that
is equivalent to no other is a class of its own. What is left between the spans are slots;
a slot that still holds sign tokens is residue that no template explains.

Scale. One map-only pass counts, per batch, pages of tokens and agreeing pages of token
pairs; only these counts are shuffled. A page's token is paired with the ``reach`` tokens of
equal count that follow it, so the counts grow with the vocabulary of signs, not with the
text. Nothing depends on how many pages a host has.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from paperlake.plans.lineage import materialize

SUPPORT, SHARE, REACH = 3, 0.6, 8
EVERY = "*"  # stands for all hosts together

_LEX = re.compile(
    r"""(?P<setext>^[ ]{0,3}[^\s|\#>][^\n|]*\n[ ]{0,3}(?:-{3,}|={3,})[ \t]*$)
    |(?P<mark>^[ \t]*(?:\#{1,6}(?=[ \t])|>(?=[ \t]*\S)|(?:[-*+]|\d{1,3}[.)])(?=[ \t]+\S)|(?:\*[ \t]*){3,}$|(?:-[ \t]*){3,}$|(?:_[ \t]*){3,}$))
    |(?P<tag></?(?P<name>[A-Za-z][\w:.-]*)(?:\s[^<>]*)?/?>)
    |(?P<link>\]\([^()\s]*(?:\s+"[^"\n]*")?\))
    |(?P<sign><!--|-->|<!\[CDATA\[|\]\]>|<[!?][A-Za-z]+[^<>]*>|&\#?\w+;?|\\(?:begin|end)\{[A-Za-z]+\*?\}|\\[A-Za-z]+\*?|\\[^\sA-Za-z0-9]
        |(?:https?|ftp)://|[\^_](?=\{)|\{\{|\}\}|\{\||\|\}|\|-+|\[\[|\]\]|[{}\[\]|<>])
    |(?P<turn>'{2,5}|={1,6}|`{1,2}|~{1,2}|\*{1,3}|_{1,3}|\${1,2}|\^)""",
    re.X | re.M,
)
_SIGNS = re.compile(r"[<>&\\{}$`\[\]*~_^|#=]|''|^\s*[-+]|^\s*\d+[.)] |://", re.M)


@dataclass(frozen=True, slots=True)
class Token:
    start: int
    end: int
    name: str


def lex(text: str, skip: list[tuple[int, int]] = ()) -> list[Token]:
    """Sign tokens outside the ranges ``skip``, by name: attributes, targets and numbers are left out of it."""
    if not _SIGNS.search(text):
        return []
    out, gaps = [], iter(skip)
    gap = next(gaps, None)
    for m in _LEX.finditer(text):
        a, b, kind = m.start(), m.end(), m.lastgroup
        while gap and a >= gap[1]:
            gap = next(gaps, None)
        if gap and b > gap[0]:
            continue
        if kind == "name" or kind == "tag":
            name = ("</" if text[a + 1] == "/" else "<") + m.group("name").lower() + ">"
        elif kind == "turn":
            name = m.group() + _role(text, a, b)
        elif kind == "link":
            name = "]("
        elif kind == "mark":
            name = "mark " + re.sub(r"\d+", "1", m.group().strip())
        else:
            name = kind if kind == "setext" else m.group()
        out.append(Token(a, b, name))
    return out


def _role(text: str, a: int, b: int) -> str:
    """o before a word or at a line's start, c after a word or at its end, m inside a word, else s."""
    left, right = a > 0 and text[a - 1].isalnum(), b < len(text) and text[b].isalnum()
    if left or right:
        return "m" if left and right else "o" if right else "c"
    first = not text[text.rfind("\n", 0, a) + 1 : a].strip()
    end = text.find("\n", b)
    last = not text[b : len(text) if end < 0 else end].strip()
    return "o" if first and not last else "c" if last and not first else "s"


def agreeing(tokens: list[Token], reach: int = REACH) -> list[tuple[str, str]]:
    """Pairs (first, second) of names that occur equally often on a page, in turns."""
    places: dict[str, list[int]] = {}
    for n, t in enumerate(tokens):
        places.setdefault(t.name, []).append(n)
    by_count: dict[int, list[str]] = {}
    for name, at in places.items():
        by_count.setdefault(len(at), []).append(name)
    out = []
    for names in by_count.values():
        names.sort(key=lambda x: places[x][0])
        for i, first in enumerate(names):
            a = places[first]
            for second in names[i + 1 : i + 1 + reach]:
                b = places[second]
                if all(x < y for x, y in zip(a, b)) and all(y < x for y, x in zip(b, a[1:])):
                    out.append((first, second))
    return out


def deduce(pages: DataFrame, code=None, support: int = SUPPORT, share: float = SHARE, reach: int = REACH) -> DataFrame:
    """(host, first, second, pages, agree) from pages (host, text): the valid classes of every host.

    second is null for a class of one token; host is ``EVERY`` for classes over all hosts.
    code(text) gives the ranges of a text that hold no markup.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = lex(text, code(text) if code else ())
                found = [(name, None) for name in {t.name for t in tokens}] + agreeing(tokens, reach)
                counts.update((h, *x) for x in found for h in (host, EVERY))
            keys = list(counts)
            columns = [pa.array([k[i] for k in keys], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([counts[k] for k in keys], pa.int64())], names=["host", "first", "second", "n"])

    texts = pages.where("text is not null").select(F.coalesce("host", F.lit("")).alias("host"), "text")
    counted = texts.mapInArrow(run, "host string, first string, second string, n bigint").groupBy("host", "first", "second").agg(F.sum("n").alias("n"))
    counted = materialize(counted.where(F.col("n") >= support), "template-counts")
    # pages of each token stand beside its pairs: one window by first, one by second
    alone = F.max(F.when(F.col("second").isNull(), F.col("n")))
    by_first = counted.withColumn("n1", alone.over(Window.partitionBy("host", "first")))
    seconds = counted.where("second is null").select("host", F.col("first").alias("second"), F.col("n").alias("n2"))
    pairs = by_first.where("second is not null").join(seconds, ["host", "second"]).where(F.col("n") >= share * F.greatest("n1", "n2"))
    best = pairs.withColumn("r", F.row_number().over(Window.partitionBy("host", "first").orderBy(F.desc("n"), "second"))).where("r = 1")
    singles = by_first.where("second is null").select("host", "first", "second", F.col("n").alias("pages"), F.col("n").alias("agree"))
    return singles.unionByName(best.select("host", "first", "second", F.greatest("n1", "n2").alias("pages"), F.col("n").alias("agree")))


class Template:
    """The classes of one host, beside those of all hosts."""

    def __init__(self, classes: list[tuple[str, str | None]]):
        self.second: dict[str, str] = {a: b for a, b in classes if b is not None}
        self.firsts: dict[str, set[str]] = {}
        for a, b in self.second.items():
            self.firsts.setdefault(b, set()).add(a)
        self.known = {a for a, b in classes if b is None}

    def spans(self, tokens: list[Token]) -> tuple[list[tuple[int, int, str]], list[Token], list[Token]]:
        """(spans (start, end, path in the template), tokens that are a class by themselves, tokens of no class)."""
        spans: list[tuple[int, int, str]] = []
        stack: list[Token] = []
        loose: list[Token] = []
        for t in tokens:
            opens = self.firsts.get(t.name)
            at = next((n for n in range(len(stack) - 1, -1, -1) if stack[n].name in opens), None) if opens else None
            if at is not None:
                # several firsts of one second, each once, are one class of three tokens or more
                own = {stack[at].name}
                while at and stack[at - 1].name in opens and stack[at - 1].name not in own:
                    at -= 1
                    own.add(stack[at].name)
                path = " > ".join(f"{s.name} {self.second[s.name]}" for s in stack[: at + 1])
                spans.append((stack[at].start, t.end, path))
                loose += stack[at + 1 :]
                del stack[at:]
            elif t.name in self.second:
                stack.append(t)
            else:
                loose.append(t)
        loose += stack
        return spans, [t for t in loose if t.name in self.known], [t for t in loose if t.name not in self.known]


_BLANK = re.compile(r"\n[^\S\n]*\n")


def pieces(text: str, template: Template, skip: list[tuple[int, int]] = ()) -> list[tuple[int, int, str, list[Token]]]:
    """(start, end, way, tokens) of the residue: everything that isn't a slot.

    way is class (a span of a class of two tokens), single (a class of one token) or slot (a
    part of one block with signs of no class). Touching pieces are one piece.
    """
    tokens = lex(text, skip)
    if not tokens:
        return []
    spans, singles, loose = template.spans(tokens)
    found = [(a, b, "class") for a, b, _ in spans] + [(t.start, t.end, "single") for t in singles]
    if loose:
        loose.sort(key=lambda t: t.start)
        a, b = loose[0].start, loose[0].end
        for t in loose[1:]:
            if _BLANK.search(text, b, t.start):
                found.append((a, b, "slot"))
                a = t.start
            b = t.end
        found.append((a, b, "slot"))
    found.sort()
    merged: list[list] = []
    for a, b, way in found:
        if merged and a <= merged[-1][1] + 1 and (a <= merged[-1][1] or text[a - 1] != "\n"):
            last = merged[-1]
            last[1] = max(last[1], b)
            last[2] = min(last[2], way)  # class before single before slot, by name
        else:
            merged.append([a, b, way])
    out, n = [], 0
    for a, b, way in merged:
        own = []
        while n < len(tokens) and tokens[n].start < b:
            if tokens[n].start >= a:
                own.append(tokens[n])
            n += 1
        out.append((a, b, way, own))
    return out


_LETTERS, _DIGITS, _MANY = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"(?:a ){3,}")


def _masked(text: str) -> str:
    return _MANY.sub("a a ", _DIGITS.sub("0", _LETTERS.sub("a", text)))


def skeleton(text: str, a: int, b: int, tokens: list[Token]) -> str:
    """A piece with one word on either side; words of its slots are masked, tokens stand as they are."""
    left = text.rfind("\n", 0, a) + 1
    head = text[max(left, text.rfind(" ", left, max(left, a - 1))) : a]
    if not head.strip():
        head = text[left:a]
    right = text.find("\n", b)
    right = len(text) if right < 0 else right
    stop = text.find(" ", b + 1, right)
    tail = text[b : right if stop < 0 else stop]
    out, at = ["a " if left < a - len(head) else "", _masked(head)], a
    for t in tokens:
        out += [_masked(text[at : t.start]), text[t.start : t.end]]
        at = max(at, t.end)
    out += [_masked(text[at:b]), _masked(tail)]
    if tail and stop >= 0:
        out.append(" a")
    return "".join(out)
