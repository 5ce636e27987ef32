"""Markup residue: HTML, MediaWiki, LaTeX and Markdown to clean text, and which kinds there were.

The residue is found by template deduction over the pages of a host (see ``template``):
equivalence classes of sign tokens, nested into the host's template; the text between them
is the slots. A scanner then names the language of a piece of residue, once for each
distinct skeleton of pieces (words masked), and renders the blocks that hold a piece. It has
an ordered list of rules (pattern, replacement) for each language; TeX quotes are read
before wiki quote marks, and escaped markup is unescaped before tags are read, so no piece
is read as two languages. A piece that no rule knows ("n > 30", "[sic]") is no residue.

The clean text is plain paragraphs; headings show as "# ", list items as "- ", table rows
with " | ", fenced code as it was, formulas as $...$.

Defined results: null gives null and no kind; empty and very long texts are whole; nested
markup is read from the inside out; a null host is a host of its own; repeated rows give one
case in p2_found; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from paperlake.functions import latex
from paperlake.llm.template import EVERY, Template, deduce, pieces, skeleton
from paperlake.plans.lineage import materialize

KINDS = ("html", "wiki", "latex", "markdown")
_CODE = re.compile(r"^(?P<fence>[ ]{0,3}(?P<mark>`{3,}|~{3,})[^\n]*\n(?:.*?\n)?[ ]{0,3}(?P=mark)[`~]*[^\S\n]*)$|^[ ]{0,3}(?:`{3,}|~{3,})[^`\n]*\n.*\Z", re.M | re.S)

# Element names of HTML; entity names that may stand without a semicolon.
_TAGS = (
    "a abbr address article aside audio b big blockquote body br button caption center cite code col colgroup dd del details "
    "dfn div dl dt em embed fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input "
    "ins kbd label legend li link main map mark meta nav nowiki ol option p pre q ref s samp script section select small source "
    "span strike strong style sub summary sup svg table tbody td textarea tfoot th thead time title tr tt u ul var video"
).split()
_OPEN_ENTITIES = "nbsp|amp|lt|gt|quot|copy|reg"
_NAME = rf"(?:(?:{'|'.join(sorted(_TAGS, key=len, reverse=True))})(?![\w:.-])|[A-Za-z][\w.-]*:[A-Za-z][\w.-]*)"
_TAG = re.compile(rf"<(?P<end>/?)(?P<name>{_NAME})(?P<rest>(?:\s+[\w:.-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))?)*)\s*/?>", re.I)
_ENTITY = re.compile(rf"&(?:#\d{{1,7}};?|#[xX][0-9a-fA-F]{{1,6}};?|[A-Za-z][A-Za-z0-9]{{1,31}};|(?:{_OPEN_ENTITIES})(?![A-Za-z0-9=]))")
_BREAKS = {"br": "\n", "p": "\n\n", "div": "\n", "ul": "\n", "ol": "\n", "tr": "\n", "table": "\n", "pre": "\n", "blockquote": "\n\n", "section": "\n", "article": "\n", "hr": "\n"}


def _tag(m: re.Match) -> str:
    name, end = m.group("name").lower().rpartition(":")[2], m.group("end")
    if re.fullmatch(r"h[1-6]", name):
        return "\n\n" if end else f"\n\n{'#' * int(name[1])} "
    if name == "title" and ":" in m.group("name"):
        return "\n\n" if end else "\n\n# "
    if name == "li":
        return "" if end else "\n- "
    if name in ("td", "th"):
        return "" if end else " | "
    return _BREAKS.get(name, "")


def _entity(m: re.Match) -> str:
    body = m.group()
    if body[1] != "#" and body[1:] not in html5 and body[1:] + ";" not in html5:
        return body
    got = html.unescape(body if body.endswith(";") else body + ";")
    return " " if got == "\xa0" else got


class _Found(set):
    """The kinds found so far; ``sub`` notes a kind when its rule changes the text."""

    def sub(self, kind: str | None, pattern: re.Pattern, by: str | Callable, text: str) -> str:
        new, n = pattern.subn(by, text)
        if n and kind and new != text:
            self.add(kind)
        return new if n else text


_R = re.compile
_COMMENT = _R(r"<!--.*?(?:-->|\Z)", re.S)
_PAIR = _R(r"<([A-Za-z][\w.-]*)>([^<>]*)</\1\s*>")
_CDATA = _R(r"<!\[CDATA\[|\]\]>")
_DOCTYPE = _R(r"<(?:!DOCTYPE|\?xml)\b[^<>]*>", re.I)
_TEX_QUOTES = _R(r"``([^`']*(?:'(?!')[^`']*)*)''")
_WIKI_TABLE = _R(r"^[ \t]*\{\|[^\n]*\n(.*?)^[ \t]*\|\}", re.M | re.S)
_WIKI_STRAY = _R(r"^[ \t]*(?:\{\|[^\n]*|\|\}|\|-+[^\n]*)$", re.M)
_WIKI_TEMPLATE = _R(r"\{\{([^{}]*\|[^{}]*)\}\}")
_WIKI_FILE = _R(r"\n?\[\[(?:Category|File|Image|Kategorie|Datei|Fichier|Archivo|Catégorie):[^\[\]]*\]\]", re.I)
_WIKI_LINK = _R(r"\[\[([^\[\]|\n]*)(?:\|([^\[\]\n]*))?\]\]")
_WIKI_URL = _R(r"\[(?:https?|ftp)://[^\s\[\]]+(?:[ \t]+([^\[\]\n]*))?\]")
_WIKI_QUOTES = _R(r"('{5}|'{2,3})(?!')([^'\n]+(?:'(?!')[^'\n]+)*)\1(?!')")
_WIKI_HEAD = _R(r"^[ \t]*(={1,6})[ \t]*([^=\n](?:[^\n]*[^=\n])?)[ \t]*\1[ \t]*$", re.M)
_DISPLAY = _R(r"\$\$(.+?)\$\$|\\\[(.+?)\\\]|\\begin\{(equation|align|eqnarray|gather|displaymath|multline)\*?\}(.*?)\\end\{\3\*?\}", re.S)
_INLINE = _R(r"\\\((.+?)\\\)|(?<![\\$\w])\$(?!\s|\$|\d[\d,.]*\s)((?:[^$\n\\]|\\.)+?)(?<!\s)\$(?![\d$])")
_ENVIRONMENT = _R(r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\])?")
_SECTION = _R(r"\\((?:sub)*)(?:section|paragraph|chapter)\*?\{([^{}]*)\}")
_ITEM = _R(r"\\item(?![A-Za-z])(?:\[[^\]\n]*\])?\s*")
_SCRIPT = _R(r"[\^_]\{([^{}\n]*)\}")
_TEX_SIGN = _R(r"\\(?:[A-Za-z]+|[&%$#_{}'\"`^~=.\\])|(?<![{\\])\{[^{}|]*\}|\{\{[^{}|]*\}\}")
_MD_IMAGE = _R(r"!\[([^\[\]\n]*)\]\([^()\s]*(?:\s+\"[^\"\n]*\")?\)")
_MD_LINK = _R(r"(?<!!)\[([^\[\]\n]+)\](?:\([^()\s]+(?:\s+\"[^\"\n]*\")?\)|\[[^\[\]\n]*\])")
_MD_NOTE = _R(r"^[ \t]*\[\^?[^\[\]\n]+\]:[^\n]*$|\[\^[^\[\]\n]+\]", re.M)
_MD_STRONG = _R(r"(?<![*\\])\*\*(?![\s*])([^*\n]+?)(?<![\s])\*\*(?!\*)|(?<![\w_\\])__(?![\s_])([^_\n]+?)(?<!\s)__(?![\w_])")
_MD_EM = _R(r"(?<![*\\\w])\*(?![\s*])([^*\n]+?)(?<![\s*])\*(?![*\w])|(?<![\w_\\])_(?![\s_{])([^_\n]+?)(?<!\s)_(?![\w_])")
_MD_STRIKE = _R(r"~~(?![\s~])([^~\n]+?)(?<!\s)~~")
_MD_CODE = _R(r"(?<!`)(`{1,2})(?!`)([^`\n]+)\1(?!`)")
_MD_HEAD = _R(r"^ {0,3}(#{1,6})[ \t]+(?=\S)", re.M)
_MD_SETEXT = _R(r"^ {0,3}([^\s|#>][^\n|]*)\n {0,3}(?:-{3,}|={3,})[ \t]*$", re.M)
_MD_RULE = _R(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$", re.M)
_MD_QUOTE = _R(r"^ {0,3}>[ \t]?(?=\S)", re.M)
_MD_LIST = _R(r"^[ \t]*(?:[-*+]|\d{1,3}[.)])[ \t]+(?=\S)", re.M)
_MD_TABLE = _R(r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$", re.M)
_MD_ESCAPE = _R(r"\\([*\[\]()<>!+`|])")
_MD_AUTO = _R(r"<((?:https?|ftp)://[^\s<>]+)>")
_HINT = _R(r"[<&\\{}$`\[*~_^|#>]|''|==|^\s*[-+=]|^\s*\d+[.)] ", re.M)


def _wiki_table(m: re.Match) -> str:
    rows = []
    for line in m.group(1).split("\n"):
        line = line.strip()
        if line and not line.startswith(("|-", "|+")):
            rows.append(" | ".join(c.strip() for c in re.split(r"!!|\|\|", line.lstrip("!|"))))
    return "\n".join(rows) + "\n"


def _template(m: re.Match) -> str:
    plain = [p for p in m.group(1).split("|")[1:] if "=" not in p]
    return plain[-1].strip() if plain else ""


def _clean_part(text: str, found: _Found, markdown_counts: bool) -> str:
    """Clean text between code blocks."""
    formulas: list[str] = []

    def keep(m: re.Match) -> str:
        body = next(g for g in reversed(m.groups()) if g is not None).strip()
        found.add("latex")
        formulas.append(f"$${body}$$" if m.re is _DISPLAY else f"${body}$")
        return f"\x10{len(formulas) - 1}\x11"

    if "<" in text or "&" in text:
        for _ in range(4):
            new = found.sub("html", _ENTITY, _entity, text)
            if new == text:
                break
            text = new
        if "<" in text:
            text = found.sub("html", _COMMENT, "", text)
            text = found.sub("html", _DOCTYPE, "", text)
            text = found.sub("markdown" if markdown_counts else None, _MD_AUTO, r"\1", text)
            text = found.sub("html", _TAG, _tag, text)
            text = found.sub("html", _PAIR, r"\2", text)
    if "[CDATA[" in text or "]]>" in text:
        text = found.sub("html", _CDATA, "", text)
    # what TeX and wiki share signs with
    text = found.sub("latex", _TEX_QUOTES, "“\\1”", text) if "``" in text else text
    if "$" in text or "\\" in text:
        text = _DISPLAY.sub(keep, text)
        text = _INLINE.sub(keep, text)
    if "{|" in text or "|}" in text:
        text = found.sub("wiki", _WIKI_TABLE, _wiki_table, text)
        text = found.sub("wiki", _WIKI_STRAY, "", text)
    while "{{" in text and (new := found.sub("wiki", _WIKI_TEMPLATE, _template, text)) != text:
        text = new
    if "[" in text:
        text = found.sub("wiki", _WIKI_FILE, "", text)
        text = found.sub("wiki", _WIKI_LINK, lambda m: m.group(2) if m.group(2) is not None else m.group(1), text)
        text = found.sub("wiki", _WIKI_URL, lambda m: m.group(1) or "", text)
    while "''" in text and (new := found.sub("wiki", _WIKI_QUOTES, r"\2", text)) != text:
        text = new
    if "=" in text:
        text = found.sub("wiki", _WIKI_HEAD, lambda m: "#" * len(m.group(1)) + " " + m.group(2).strip(), text)
    count = "markdown" if markdown_counts else None
    if "\\" in text or "{" in text:
        text = found.sub(count, _MD_ESCAPE, r"\1", text)
        text = found.sub("latex", _SCRIPT, lambda m: m.group(0)[0] + m.group(1), text)
        if _TEX_SIGN.search(text):
            found.add("latex")
            text = _SECTION.sub(lambda m: f"\n{'#' * (1 + len(m.group(1)) // 3)} {m.group(2)}\n", text)
            text = _ITEM.sub("\n- ", text)
            text = latex.plain(_ENVIRONMENT.sub("", text))
    if "`" in text:
        text = found.sub(count, _MD_CODE, r"\2", text)
    if "[" in text:
        text = found.sub(count, _MD_IMAGE, r"\1", text)
        text = found.sub(count, _MD_LINK, r"\1", text)
        text = found.sub(count, _MD_NOTE, "", text)
    if "*" in text or "_" in text:
        text = found.sub(count, _MD_RULE, "", text)
        if "**" in text or "__" in text:
            text = found.sub(count, _MD_STRONG, lambda m: m.group(1) or m.group(2), text)
        text = found.sub(count, _MD_EM, lambda m: m.group(1) or m.group(2), text)
    if "~~" in text:
        text = found.sub(count, _MD_STRIKE, r"\1", text)
    if "--" in text or "==" in text:
        text = found.sub(count, _MD_TABLE, "", text)
        text = found.sub(count, _MD_SETEXT, r"# \1", text)
        text = found.sub(count, _MD_RULE, "", text)
    if markdown_counts and "markdown" not in found and (_MD_HEAD.search(text) and not found & {"html", "wiki", "latex"} or _MD_QUOTE.search(text)):
        found.add("markdown")
    text = _MD_QUOTE.sub("", text)
    for n, formula in enumerate(formulas):
        text = text.replace(f"\x10{n}\x11", formula)
    return _spaces(text)


def _spaces(text: str) -> str:
    """Without spaces at line ends, double spaces and more than one empty line."""
    if " \n" in text or "\t" in text:
        text = re.sub(r"[^\S\n]+\n", "\n", text)
    if "  " in text:
        text = re.sub(r"(?<=\S) {2,}(?=\S)", " ", text)
    return re.sub(r"\n{3,}", "\n\n", text)


def clean_markup(text: str | None, markdown_counts: bool = True) -> tuple[str | None, set[str]]:
    """(clean text, kinds of residue found). markdown_counts: the field should hold no Markdown."""
    if text is None:
        return None, set()
    if not _HINT.search(text):
        return text.strip(), set()
    found, out, at = _Found(), [], 0
    if markdown_counts:  # before other headings and lists become "# " and "- "
        if _MD_HEAD.search(text) or _MD_LIST.search(text):
            found.add("markdown")
    if "```" in text or "~~~" in text:
        for m in _CODE.finditer(text):
            out.append(_clean_part(text[at : m.start()], found, markdown_counts))
            out.append(m.group())
            at = m.end()
            if markdown_counts:
                found.add("markdown")
    out.append(_clean_part(text[at:], found, markdown_counts))
    return "".join(out).strip(), set(found)


MAX_BROADCAST = 200_000  # classes sent to all executors, some 100 bytes each
SALTS = 16
SKELETONS = 200_000  # remembered by a task
_BLANK = re.compile(r"\n[^\S\n]*\n\s*")


def code_ranges(text: str) -> list[tuple[int, int]]:
    """Fenced code of a text."""
    return [m.span() for m in _CODE.finditer(text)] if "```" in text or "~~~" in text else []


class Reader:
    """Reads texts by a host's template; names are remembered by skeleton."""

    def __init__(self, template: Template, names: dict | None = None):
        self.template, self.names = template, {} if names is None else names

    def kinds(self, text: str, found: list, skip: list, markdown_counts: bool) -> dict[str, str]:
        """The kinds of residue, each with the best way (class, single, slot) that found it."""
        out = {"markdown": "class"} if skip and markdown_counts else {}
        for a, b, way, tokens in found:
            key = (skeleton(text, a, b, tokens), markdown_counts)
            names = self.names.get(key)
            if names is None:
                if len(self.names) >= SKELETONS:
                    self.names.clear()
                names = self.names[key] = tuple(clean_markup(*key)[1])
            for kind in names:
                out[kind] = min(out.get(kind, way), way)
        return out

    def read(self, text: str | None, markdown_counts: bool = True, with_text: bool = True) -> tuple[str | None, dict[str, str]]:
        """(clean text, kinds with their ways) of one text."""
        if text is None:
            return None, {}
        skip = code_ranges(text)
        found = pieces(text, self.template, skip)
        kinds = self.kinds(text, found, skip, markdown_counts)
        return (_rendered(text, found, skip, markdown_counts) if with_text else ""), kinds


def _rendered(text: str, found: list, skip: list[tuple[int, int]], markdown_counts: bool) -> str:
    """The text with the blocks rendered that hold a piece; other blocks and code stay."""
    held = [(a, b) for a, b, _, _ in found]
    out, at = [], 0
    for a, b in [*skip, (len(text), len(text))]:
        cuts, n, edge = [at], 0, 0
        for m in _BLANK.finditer(text, at, a):
            while n < len(held) and held[n][0] < m.end():
                edge = max(edge, held[n][1])
                n += 1
            if edge <= m.start():
                cuts.append(m.end())
        done, n = [], 0
        for x, y in zip(cuts, [*cuts[1:], a]):
            while n < len(held) and held[n][1] <= x:
                n += 1
            block = text[x:y]
            if n < len(held) and held[n][0] < y:
                tail = block[len(block.rstrip()) :]
                block = _clean_part(block.rstrip(), _Found(), markdown_counts) + tail
            done.append(block)
        out += [_spaces("".join(done)), text[a:b]]
        at = b
    return "".join(out).strip()


_RESULT = "field string, record_id bigint, clean string, kinds array<string>, ways array<string>"


def residue(rows: DataFrame, with_text: bool = True, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(field, record_id, clean, kinds, ways) of rows (field, record_id, host, text, counts).

    counts: the field should hold no Markdown. ways tells for each kind whether a class of two
    tokens, a class of one or a slot with unexplained signs gave it.
    """
    rows = rows.select("field", F.col("record_id").cast("bigint").alias("record_id"), F.concat_ws("/", "field", F.coalesce("host", F.lit(""))).alias("host"), F.col("text").cast("string").alias("text"), "counts")
    classes = materialize(deduce(rows, code_ranges).select("host", "first", "second"), "templates")
    small = classes.limit(max_broadcast + 1).count() <= max_broadcast
    shared = None
    if small:
        by_host: dict[str, list[tuple[str, str | None]]] = {}
        for host, first, second in classes.collect():
            by_host.setdefault(host, []).append((first, second))
        shared = rows.sparkSession.sparkContext.broadcast(by_host)
    else:
        held = classes.groupBy("host").agg(F.collect_list(F.struct("first", "second")).alias("own"))
        salts = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        every = salts.where(F.col("host") == EVERY).select("salt", F.col("own").alias("every"))
        rows = rows.withColumn("salt", F.pmod(F.hash("record_id"), F.lit(SALTS))).join(salts, ["host", "salt"], "left").join(every, "salt", "left")
        rows = rows.select("field", "record_id", "host", "text", "counts", "own", "every")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict = {}
        readers: dict = {}
        for batch in batches:
            data = [c.to_pylist() for c in batch.columns]
            cleans, kinds, ways = [], [], []
            for n, (host, text, counts) in enumerate(zip(data[2], data[3], data[4])):
                reader = readers.get(host)
                if reader is None:
                    if shared is not None:
                        own = shared.value.get(EVERY, []) + shared.value.get(host, [])
                    else:
                        own = [(c["first"], c["second"]) for c in (data[6][n] or []) + (data[5][n] or [])]
                    reader = readers[host] = Reader(Template(own), names)
                clean, found = reader.read(text, counts, with_text)
                cleans.append(clean if with_text else None)
                kinds.append(sorted(found))
                ways.append([found[k] for k in kinds[-1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cleans, pa.string()), pa.array(kinds, pa.list_(pa.string())), pa.array(ways, pa.list_(pa.string()))],
                names=["field", "record_id", "clean", "kinds", "ways"],
            )

    return rows.mapInArrow(run, _RESULT)


def fields(df: DataFrame, id_col: str, text_col: str, field: str, markdown_counts: bool = True, host_col: str | None = None) -> DataFrame:
    """The rows of one field as ``residue`` takes them."""
    host = F.col(f"`{host_col}`").cast("string") if host_col else F.lit(None).cast("string")
    return df.select(F.lit(field).alias("field"), F.col(f"`{id_col}`").cast("bigint").alias("record_id"), host.alias("host"), F.col(f"`{text_col}`").cast("string").alias("text"), F.lit(markdown_counts).alias("counts"))


def found_kinds(rows: DataFrame) -> DataFrame:
    """(field, record_id, kind) of every field with residue."""
    got = residue(rows.where("text is not null"), with_text=False)
    return got.select("field", "record_id", F.explode("kinds").alias("kind")).distinct()
