"""LaTeX in short texts to plain text: accents, letters, escapes, commands, braces, quotes."""

from __future__ import annotations

import re
import unicodedata

# Accent commands and their combining marks; letter commands and their letters.
_MARKS = {
    "`": "\u0300", "'": "\u0301", "^": "\u0302", "~": "\u0303", "=": "\u0304", ".": "\u0307", '"': "\u0308",
    "b": "\u0331", "c": "\u0327", "d": "\u0323", "H": "\u030b", "k": "\u0328", "r": "\u030a", "u": "\u0306", "v": "\u030c",
}
_LETTERS = {
    "AA": "Å", "aa": "å", "AE": "Æ", "ae": "æ", "DH": "Ð", "dh": "ð", "i": "i", "j": "j", "L": "Ł", "l": "ł", "O": "Ø", "o": "ø",
    "OE": "Œ", "oe": "œ", "ss": "ß", "TH": "Þ", "th": "þ", "S": "§", "P": "¶", "copyright": "©", "pounds": "£", "dots": "…",
    "ldots": "…", "textellipsis": "…", "textendash": "–", "textemdash": "—", "TeX": "TeX", "LaTeX": "LaTeX",
}
_ESCAPE = re.compile(r"\\([&%$#_{}])")
_DROP = re.compile(r"\s?\\(?:cite[a-z]*|ref|label|footnote(?:mark)?|index|vspace|hspace|bibitem)\*?(?:\[[^\]\n]*\])*\{[^{}]*\}")
_COMMAND = re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\s*")
_QUOTED = re.compile(r"``(.+?)''", re.S)


def _name_end(text: str, at: int) -> int:
    """Where the command name ends that starts at ``at``: a run of ASCII letters, or one sign."""
    end = at
    while end < len(text) and text[end].isascii() and text[end].isalpha():
        end += 1
    return max(end, min(at + 1, len(text)))


def _base(text: str, at: int) -> tuple[str, int]:
    """(the one letter an accent stands on, where it ends); ("", at) if there is none."""
    start = at
    while at < len(text) and text[at].isspace():
        at += 1
    braced = text[at : at + 1] == "{"
    if braced:
        at += 1
        while at < len(text) and text[at].isspace():
            at += 1
    if text[at : at + 1] == "\\":
        at += 1
    letter = text[at : at + 1]
    if not (letter.isascii() and letter.isalpha()):
        return "", start
    at += 1
    if braced:
        while at < len(text) and text[at].isspace():
            at += 1
        if text[at : at + 1] != "}":
            return "", start
        at += 1
    return letter, at


def _resolved(text: str, at: int) -> tuple[str, int] | None:
    """(what the command at the backslash ``at`` typesets, where it ends), for accents and letters."""
    end = _name_end(text, at + 1)
    name = text[at + 1 : end]
    if name in _LETTERS:
        if text.startswith("{}", end):
            end += 2
        elif text[end : end + 1].isspace() and text[end + 1 : end + 2].strip():
            end += 1
        return _LETTERS[name], end
    if name in _MARKS:
        letter, end = _base(text, end)
        if letter:
            return unicodedata.normalize("NFC", letter + _MARKS[name]), end
    return None


def accents(text: str) -> str:
    """Accent and letter commands resolved, with braces that held only them."""
    out, at = "", 0
    while (slash := text.find("\\", at)) >= 0:
        out += text[at:slash]
        got = _resolved(text, slash)
        if got is None:
            at = slash + 2
            out += text[slash:at]
            continue
        letter, at = got
        if out.endswith("{") and text[at : at + 1] == "}":
            out, at = out[:-1], at + 1
        out += letter
    return out + text[at:]


def plain(text: str) -> str:
    """Text without LaTeX: what a reader of the typeset line sees."""
    text = _QUOTED.sub("“\\1”", text)
    if "\\" in text:
        text = accents(text)
        text = _DROP.sub("", text)
        text = _ESCAPE.sub(lambda m: {"{": "\x02", "}": "\x03"}.get(m.group(1), m.group(1)), text)
        text = _COMMAND.sub("", text)
    text = re.sub(r"[\^_]\{([^{}]*)\}", r"\1", text)
    text = re.sub(r"(?<=\S)~(?=\S)", " ", text)
    return text.replace("{", "").replace("}", "").replace("\x02", "{").replace("\x03", "}")
