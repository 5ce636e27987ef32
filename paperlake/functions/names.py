"""Surnames of packed author lists, for comparison."""

from __future__ import annotations

import html
import re

from paperlake.functions import latex, packed
from paperlake.functions.fold import fold

_PARTICLE = re.compile(rf"(?:^|\s)((?:{'|'.join(sorted(packed.PARTICLES))})\s.*)$")
_LETTERS = re.compile(r"[^a-z]+")


def surname(name: str) -> str:
    """Folded letters of the surname; all letters of an organisation's name."""
    name = latex.plain(html.unescape(name)).strip()
    words = name.replace(",", " ").split()
    if any(w.lower() in packed.ORG_WORDS for w in words) and any(w in packed.ORG_LINKS or w.lower() in packed.ORG_WORDS and w != w.lower() for w in words):
        return _LETTERS.sub("", fold(name))
    if "," in name:
        return _LETTERS.sub("", fold(name.split(",")[0]))
    if m := _PARTICLE.search(name):
        return _LETTERS.sub("", fold(m.group(1)))
    words = [w for w in words if len(w.strip(".")) > 1 and w.lower().strip(".") not in packed.SUFFIXES] or words
    return _LETTERS.sub("", fold(words[-1])) if words else ""


def surnames(authors: str | None) -> list[str]:
    """Distinct surnames of a packed list, in order."""
    if not authors:
        return []
    spans = packed.resolve(packed.skeleton(authors))
    return list(dict.fromkeys(s for n in packed.extract(authors, spans) if (s := surname(n))))


_SENIORITY = frozenset(("jr", "sr", "ii", "iii", "iv"))


def given_name_first(name: str) -> str:
    """"Last, First" and "Last, Jr., First" with the given name first; a name with other commas stays."""
    last, *rest = (p.strip() for p in name.split(","))
    if len(rest) == 1 and last and rest[0]:
        return f"{rest[0]} {last}"
    if len(rest) == 2 and last and rest[1] and rest[0].lower().rstrip(".") in _SENIORITY:
        return f"{rest[1]} {last}, {rest[0]}"
    return name
