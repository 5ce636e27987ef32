"""Folding of text: case, accents and letters that carry no combining mark."""

from __future__ import annotations

import unicodedata

# Letters without a decomposition and their plain forms.
_PLAIN = {"ø": "o", "đ": "d", "ð": "d", "ł": "l", "ı": "i", "ħ": "h", "æ": "ae", "œ": "oe", "ß": "ss", "þ": "th", "ŋ": "n"}


class _Unmarked(dict):
    """What stands for a character: nothing for a combining mark."""

    def __missing__(self, c: str) -> str:
        self[c] = out = "" if unicodedata.combining(c) else c
        return out


_MARKS, _FOLDED = _Unmarked(), _Unmarked(_PLAIN)


def _replaced(text: str, table: dict[str, str]) -> str:
    """The text with its characters replaced, one pass for each distinct one that changes."""
    for c in set(text):
        if c > "\x7f" and (to := table[c]) != c:
            text = text.replace(c, to)
    return text


def unmarked(text: str) -> str:
    """Compatibility forms resolved and combining marks dropped."""
    return text if text.isascii() else _replaced(unicodedata.normalize("NFKD", text), _MARKS)


def fold(text: str) -> str:
    """Lower case without accents; ligatures and compatibility forms in plain letters."""
    return text.lower() if text.isascii() else _replaced(unicodedata.normalize("NFKD", text).lower(), _FOLDED)
