"""Packed lists of names: tokens, delimiter skeletons and the rules resolved from them.

A skeleton is the string with every ordinary character masked: words become ``w``,
single-letter initials ``i``, name particles ``p``, words that only organisations have
``o``; delimiters, quotes and brackets stay. All decisions depend on the skeleton alone,
so a rule is resolved once per distinct skeleton and then applied by position.
"""

from __future__ import annotations

import json
import re

# Words with a role in packed name lists.
PARTICLES = frozenset("de la van von der den del di da du le dos das ter ten af av el bin ibn zu zur".split())
SUFFIXES = frozenset("jr sr ii iii iv".split())
ORG_LINKS = frozenset("of for the on in from".split())
ORG_WORDS = frozenset(
    "council institute university society association committee centre center agency ministry department office group "
    "consortium network collaboration foundation board commission bureau laboratory laboratories college school union "
    "federation organization organisation team project initiative library archive archives museum academy service services "
    "trust authority".split()
)

_TOKEN = re.compile(
    r"""(?P<ent>&(?:\#\d+|\#x[0-9a-fA-F]+|[a-zA-Z]+);)
      |(?P<esc>\\u[0-9a-fA-F]{4}|\\n|\\t|\\r)
      |(?P<tex>\{?\\(?:[`'^"~=.uvHtcdbrk]\s*(?:\{\\?[A-Za-z]+\}|\\[ij]\b|[A-Za-z])|[a-zA-Z]+(?:\{\})?)\}?)
      |(?P<word>[^\W_](?:[̀-ͯ'’\-‐]*[^\W_]|[̀-ͯ])*)
      |(?P<nl>[ ]*(?:\r\n|\n|\r)\s*)
      |(?P<tab>\t+)
      |(?P<ws>[^\S\t\r\n]+)
      |(?P<mark>\|+|;+|；|[,，、/&\[\]{}"'.])
      |(?P<other>.)""",
    re.X | re.S,
)


def tokens(text: str, escaped: bool = False) -> list[tuple[str, int, int]]:
    """(class, start, end) of every token; letters joined over entities, TeX and escapes."""
    out: list[tuple[str, int, int]] = []
    for m in _TOKEN.finditer(text):
        kind, s, e = m.lastgroup, m.start(), m.end()
        got = m.group()
        if kind == "esc" and not escaped and not got.startswith("\\u"):
            kind = "tex"
        if kind in ("ent", "tex", "word", "esc"):
            cls = "W"
        elif kind == "nl":
            cls = "n"
        elif kind == "tab":
            cls = "t"
        elif kind == "ws":
            cls = "_"
        elif kind == "mark":
            cls = "|" if got[0] == "|" else ";" if got[0] in ";；" else "," if got in ",，、" else got
        else:
            cls = "W" if got.isalnum() or ord(got) > 127 and not got.isspace() or got in "\\^~`$_-" else "x"
        if cls == "W" and out and out[-1][0] == "W" and out[-1][2] == s:
            out[-1] = ("W", out[-1][1], e)
        else:
            out.append((cls, s, e))
    # braces inside a word belong to it: V{\'e}pelesk, {\'E}mile
    merged: list[tuple[str, int, int]] = []
    i = 0
    while i < len(out):
        c, s, e = out[i]
        if c == "{" and i + 2 < len(out) and out[i + 1][0] == "W" and out[i + 2][0] == "}":
            left = merged and merged[-1][0] == "W" and merged[-1][2] == s
            right = i + 3 < len(out) and out[i + 3][0] == "W" and out[i + 3][1] == out[i + 2][2]
            if left or right:
                s0 = merged.pop()[1] if left else s
                e0 = out[i + 3][2] if right else out[i + 2][2]
                out[i + (3 if right else 2)] = ("W", s0, e0)
                i += 3 if right else 2
                continue
        if c == "W" and merged and merged[-1][0] == "W" and merged[-1][2] == s:
            merged[-1] = ("W", merged[-1][1], e)
        elif c == "'" and merged and merged[-1][0] == "W" and merged[-1][2] == s and i + 1 < len(out) and out[i + 1][0] == "W" and out[i + 1][1] == e:
            merged[-1] = ("W", merged[-1][1], out[i + 1][2])
            i += 1
        else:
            merged.append((c, s, e))
        i += 1
    return [(_word_class(text[s:e]) if c == "W" else c, s, e) for c, s, e in merged]


def _word_class(word: str) -> str:
    low = word.lower()
    if low in ("and", "und"):
        return "+"
    if low in ("et", "al", "others"):
        return {"et": "E", "al": "A", "others": "O"}[low]
    if low in PARTICLES and word == low:
        return "p"
    if low in SUFFIXES and low != "iv" or word in ("IV",):
        return "j"
    if low in ORG_LINKS and word == low:
        return "f"
    if low in ORG_WORDS and word != low:
        return "o"
    if len(word) == 1 and word.isalpha() and word == word.upper():
        return "i"
    if re.fullmatch(r"(?:[A-Z]-?){2,3}", word) and len(word.replace("-", "")) <= 3:
        return "i"
    return "w"


def skeleton(text: str | None) -> str | None:
    """The delimiter skeleton of ``text``; None for null."""
    if text is None:
        return None
    return "".join(c for c, _, _ in tokens(text, text.lstrip()[:1] in ('[', '"')))


def _trim(sk: str, a: int, b: int) -> tuple[int, int]:
    while a < b and sk[a] in "_nt":
        a += 1
    while b > a and sk[b - 1] in "_nt":
        b -= 1
    return a, b


def _unwrap(sk: str, a: int, b: int) -> tuple[int, int]:
    """Without white space and without quotes or braces that enclose all of it."""
    while True:
        a, b = _trim(sk, a, b)
        if b - a >= 2 and (sk[a], sk[b - 1]) in (("{", "}"), ('"', '"'), ("'", "'")):
            inner, depth = sk[a + 1 : b - 1], 0
            if sk[a] == "{":
                ok = True
                for c in inner:
                    depth += (c == "{") - (c == "}")
                    ok &= depth >= 0
                if not ok:
                    return a, b
            elif sk[a] in inner:
                return a, b
            a, b = a + 1, b - 1
        else:
            return a, b


def _pieces(sk: str, a: int, b: int, is_cut) -> list[tuple[int, int]]:
    """Cut [a, b) at the top-level token runs for which is_cut gives their length."""
    out, depth, quote, i, start = [], 0, "", a, a
    while i < b:
        c = sk[i]
        if quote:
            if c == quote:
                quote = ""
        elif c == "{":
            depth += 1
        elif c == "}":
            depth = max(0, depth - 1)
        elif c in "\"'" and (i == a or sk[i - 1] in "_nt,;|[/") and c in sk[i + 1 : b]:
            quote = c
        elif depth == 0 and (n := is_cut(i)):
            out.append((start, i))
            i += n
            start = i
            continue
        i += 1
    out.append((start, b))
    return out


def _kind(sk: str, a: int, b: int) -> str:
    """i initials, j suffix, s one surname-like word, g given name and initials, f full name, o organisation."""
    body = sk[a:b]
    words = [c for c in body if c in "wpijfo+EAO"]
    if "f" in words or "o" in words:
        return "o"
    core = [c for c in words if c != "p"]
    if not core:
        return "s" if words else ""
    if all(c == "i" for c in core):
        return "i"
    if all(c == "j" for c in core):
        return "j"
    if len(core) == 1:
        return "f" if words[0] == "w" and "p" in words else "s"
    if core[0] == "w" and all(c == "i" for c in core[1:]):
        return "g"
    return "f"


def _is_none(sk: str, a: int, b: int) -> bool:
    body = re.sub(r"[_nt.,;]", "", sk[a:b]).lstrip("+&")
    return body in ("", "EA", "O", "A", "E")


def _comma_list(sk: str, parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Names among the comma-parted pieces: Last, First pairs or whole names."""
    parts = [p for p in (_lead(sk, *_trim(sk, *p)) for p in parts) if p[0] < p[1] and not _is_none(sk, *p)]
    kinds = [_kind(sk, *_unwrap(sk, *p)) for p in parts]
    out, i = [], 0
    whole = sum(k == "f" for k in kinds)
    while i < len(parts):
        a, b = parts[i]
        j = i + 1
        if kinds[i] == "s" and j < len(parts):
            if kinds[j] == "j" and j + 1 < len(parts) and kinds[j + 1] in "igs":
                b, j = parts[j + 1][1], j + 2
            elif kinds[j] in ("i", "g", "j") or kinds[j] == "s" and not whole:
                b, j = parts[j][1], j + 1
            if j < len(parts) and kinds[j] == "j":
                b, j = parts[j][1], j + 1
        elif kinds[i] in ("f", "g") and j < len(parts) and kinds[j] in ("j", "i"):
            b, j = parts[j][1], j + 1
        out.append((a, b))
        i = j
    return out


def _lead(sk: str, a: int, b: int) -> tuple[int, int]:
    """Without a leading "and" or "&" (after a serial comma)."""
    while a < b and sk[a] in "+&":
        a, b = _trim(sk, a + 1, b)
    return a, b


def _split(sk: str, a: int, b: int) -> list[tuple[int, int]]:
    """Spans of names in [a, b), not JSON."""
    a, b = _trim(sk, a, b)
    if a >= b:
        return []
    u = _unwrap(sk, a, b)
    if u != (a, b) and sk[a] in "{\"'":
        return [u] if not _is_none(sk, *u) else []
    body = sk[a:b]
    strong = None
    for c in ("|", ";", "t"):
        if len(_pieces(sk, a, b, lambda i, c=c: sk[i] == c)) > 1:
            strong = c
            break
    if strong is None and len(_pieces(sk, a, b, lambda i: sk[i] == "/")) > 1:
        strong = "/"
    if strong is None and "n" in body:
        inside = [k for k in range(a, b) if sk[k] == "n" and sk[k - 1 if k > a else a] not in "+&,;" and sk[k + 1 if k + 1 < b else k] not in "+&"]
        if inside and not _joined(sk, a, b):
            strong = "n"
    if strong:
        out = []
        for p in _pieces(sk, a, b, lambda i: 1 if sk[i] == strong else 0):
            out += _split_joined(sk, *_lead(sk, *_trim(sk, *p)))
        return out
    return _split_joined(sk, a, b)


def _joined(sk: str, a: int, b: int) -> bool:
    return len(_pieces(sk, a, b, lambda i: _joint(sk, i, a, b))) > 1


def _joint(sk: str, i: int, a: int, b: int) -> int:
    """Length of an "and" or "&" between names at i, else 0."""
    if sk[i] not in "+&" or i == a or i + 1 >= b or sk[i - 1] not in "_nt,;." or sk[i + 1] not in "_nt":
        return 0
    return 1


def _split_joined(sk: str, a: int, b: int) -> list[tuple[int, int]]:
    a, b = _trim(sk, a, b)
    if a >= b or _is_none(sk, a, b):
        return []
    if _unwrap(sk, a, b) != (a, b):
        return [(a, b)]
    quoted = _pieces(sk, a, b, lambda i: 1 if sk[i] == "," else 0)
    if len(quoted) > 1 and all(sk[x] in "\"'{" and _unwrap(sk, x, y) != (x, y) for x, y in (_trim(sk, *p) for p in quoted) if x < y):
        return [_trim(sk, *p) for p in quoted if not _is_none(sk, *p)]
    cuts = _pieces(sk, a, b, lambda i: _joint(sk, i, a, b))
    segments = _orgs(sk, cuts)
    out = []
    for s in segments:
        parts = _pieces(sk, *s, lambda i: 1 if sk[i] == "," else 0)
        if len(parts) == 1:
            s = _trim(sk, *s)
            out += [] if _is_none(sk, *s) else [s]
        else:
            out += _comma_list(sk, parts)
    return out


def _orgs(sk: str, cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Join pieces that "and" parted inside the name of an organisation."""
    out: list[tuple[int, int]] = []
    for p in cuts:
        if out:
            x, y = out[-1]
            last = _pieces(sk, x, y, lambda i: 1 if sk[i] == "," else 0)[-1]
            q = _trim(sk, *p)
            if "}" in sk[x:y]:
                out.append(p)
                continue
            first = _pieces(sk, *q, lambda i: 1 if sk[i] == "," else 0)[0]
            if _kind(sk, *_trim(sk, *last)) == "o" and _kind(sk, *first) in ("s", "f", "o") and not ({"i", "f", "o"} & set(sk[first[0] : first[1]]) or "," in sk[q[0] : q[1]]) and sk[y - 1] == "_" and sk[max(x, y - 2)] != ",":
                out[-1] = (x, p[1])
                continue
        out.append(p)
    return out


def resolve(sk: str | None) -> list[tuple[int, int, bool]]:
    """(first token, end token, JSON-escaped) of each name, in order."""
    if not sk:
        return []
    a, b = _trim(sk, 0, len(sk))
    if a >= b:
        return []
    if b - a >= 2 and sk[a] == "[" and sk[b - 1] == "]":
        out = []
        for p in _pieces(sk, a + 1, b - 1, lambda i: 1 if sk[i] == "," else 0):
            x, y = _trim(sk, *p)
            if y - x >= 2 and sk[x] == '"' and sk[y - 1] == '"':
                x, y = x + 1, y - 1
                out += [(*s, True) for s in _split(sk, x, y)]
            else:
                out += [(*s, False) for s in _split(sk, x, y)]
        spans = out
    else:
        json_string = sk[a] == '"' and sk[b - 1] == '"' and '"' not in sk[a + 1 : b - 1]
        spans = [(*s, json_string) for s in _split(sk, a, b)]
    done = []
    for x, y, esc in spans:
        x, y = _unwrap(sk, x, y)
        while x < y and sk[y - 1] in ",;|":
            x, y = _trim(sk, x, y - 1)
        if not _is_none(sk, x, y):
            done.append((x, y, esc))
    return done


def extract(text: str, spans: list[tuple[int, int, bool]]) -> list[str]:
    """The names at the token spans of ``text``."""
    toks = tokens(text, text.lstrip()[:1] in ('[', '"'))
    out = []
    for a, b, esc in spans:
        name = text[toks[a][1] : toks[b - 1][2]]
        if esc and "\\" in name and not re.search(r"\{\\(?!\\)", name):  # TeX is no escape
            try:
                name = json.loads(f'"{name}"')
            except ValueError:
                pass
        out.append(name)
    return out
