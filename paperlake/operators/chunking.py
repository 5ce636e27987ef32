"""Structure-aware chunks of Markdown texts, and the pages they are on.

Both walk one document with a cursor, so they run per document, parallel across documents.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from paperlake.plans.lineage import materialize

MOST, OVERLAP, LEAST = 1800, 200, 512
_HEADER = re.compile(r"^#{2,3}[ \t]+(.*)$", re.M)
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=\S)")


def sections(markdown: str) -> list[tuple[str | None, str]]:
    """(header, body) of each part between ## and ### headers; empty bodies are dropped."""
    out, at, header = [], 0, None
    for m in _HEADER.finditer(markdown):
        out.append((header, markdown[at : m.start()].strip()))
        header, at = m.group(1).strip(), m.end()
    out.append((header, markdown[at:].strip()))
    return [(h, b) for h, b in out if b]


def _is_table(block: str) -> bool:
    lines = [line for line in block.split("\n") if line.strip()]
    return len(lines) > 1 and all(line.lstrip().startswith("|") for line in lines)


def _units(body: str, most: int) -> list[tuple[str, str]]:
    """(what parts it from the one before, text): paragraphs; those over the limit as sentences, lines, pieces."""
    out = []
    for paragraph in filter(str.strip, _PARAGRAPH.split(body)):
        paragraph, apart = paragraph.strip(), "\n\n"
        if len(paragraph) <= most or _is_table(paragraph):
            out.append((apart, paragraph))
            continue
        for sentence in _SENTENCE.split(paragraph):
            for line in [sentence] if len(sentence) <= most else sentence.split("\n"):
                while len(line) > most:
                    cut = line.rfind(" ", most // 2, most)
                    cut = cut if cut > 0 else most
                    out.append((apart, line[:cut].strip()))
                    line, apart = line[cut:].strip(), " "
                if line.strip():
                    out.append((apart, line.strip()))
                    apart = "\n" if len(sentence) > most else " "
            apart = " "
    return out


def _pack(units: list[tuple[str, str]], most: int, overlap: int, least: int) -> list[str]:
    chunks: list[str] = []
    now, tail = "", ""
    for apart, unit in units:
        joined = f"{now}{apart}{unit}" if now else unit
        if len(joined) <= most or not now:
            now = joined
            continue
        chunks.append(now)
        tail = now[-overlap:] if overlap else ""
        tail = tail[tail.find(" ") + 1 :] if " " in tail else ""
        tail = f"{tail}{apart}" if tail and len(tail) + len(apart) + len(unit) <= most else ""
        now = tail + unit
    if now:
        fresh = now[len(tail) :]
        if chunks and len(now) < least and len(chunks[-1]) + 2 + len(fresh) <= most:
            chunks[-1] += units[-1][0] + fresh
        else:
            chunks.append(now)
    return chunks


def chunk_text(markdown: str | None, most: int = MOST, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[str | None, str, int]]:
    """(section_header, text, char_offset) of the chunks of a text."""
    out, cursor = [], 0
    for header, body in sections(markdown or ""):
        for text in _pack(_units(body, most), most, overlap, least):
            at = markdown.find(text[:80], cursor)
            if at < 0:
                at = markdown.find(text[:80])
            out.append((header, text, max(at, 0)))
            cursor = max(at, 0) + len(text) // 2
    return out


def chunk_documents(texts: DataFrame, id_col: str = "paper_id", text_col: str = "markdown", most: int = MOST, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """(doc_id, chunk_index, section_header, text, char_offset) of every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, n, *c) for d, t in zip(b["doc_id"], b["text"]) for n, c in enumerate(chunk_text(t, most, overlap, least))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "section_header", "text", "char_offset"])

    rows = texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id bigint, chunk_index int, section_header string, text string, char_offset bigint")


def embedding_text(title: str = "title", section: str = "section_header", text: str = "text") -> Column:
    """Title, section and text parted by " | ", blank parts left out."""
    return F.concat_ws(" | ", *(F.when(F.trim(c) != "", F.col(c)) for c in (title, section, text)))


def section_heads(texts: DataFrame, id_col: str = "paper_id", text_col: str = "markdown") -> DataFrame:
    """(doc_id, n, header): the ## and ### headers of each text, as columns only."""
    heads = F.regexp_extract_all(F.col(text_col), F.lit(r"(?m)^#{2,3}[ \t]+(.*)$"), F.lit(1))
    return texts.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.posexplode(heads).alias("n", "header")).select("doc_id", F.col("n").cast("bigint").alias("n"), F.trim("header").alias("header"))


def chunks_between(chunks: DataFrame, first: int, last: int) -> DataFrame:
    """(doc_id, chunk_index, char_offset, char_end) of an index range."""
    return chunks.where(F.col("chunk_index").between(first, last)).select("doc_id", "chunk_index", "char_offset", (F.col("char_offset") + F.length("text")).alias("char_end")).distinct()


def missing_between(chunks: DataFrame, ids: DataFrame, first: int, last: int) -> DataFrame:
    """(doc_id, chunk_index) of an index range that the given documents don't have."""
    asked = ids.select("doc_id").distinct().withColumn("chunk_index", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return asked.join(chunks.select("doc_id", "chunk_index"), ["doc_id", "chunk_index"], "left_anti")


NEIGHBOURS = 16  # chunks on either side that the first round of ``context`` looks at


def context(chunks: DataFrame, asked: DataFrame, most: int = 2000, slack: int = 200) -> DataFrame:
    """(doc_id, chunk_index, context): each asked chunk with neighbours, alternately before and after.

    A chunk meets its neighbours by blocks of chunk indices, so no task gets a whole document; the
    few whose neighbours are so short that a block isn't enough go on with larger blocks.
    """
    near = chunks.select("doc_id", "chunk_index", "text").where("text is not null").dropDuplicates(["doc_id", "chunk_index"])
    todo, width, done = asked.select("doc_id", "chunk_index").distinct(), NEIGHBOURS, None
    while True:
        got = materialize(_widened(near, todo, width, most, slack), "context")
        whole = got.where("whole").select("doc_id", "chunk_index", "context")
        done = whole if done is None else done.unionByName(whole)
        todo = got.where("not whole").select("doc_id", "chunk_index")
        if todo.first() is None:
            return done
        width *= 8


def _widened(near: DataFrame, asked: DataFrame, width: int, most: int, slack: int) -> DataFrame:
    block = lambda c: F.floor(F.col(c) / width)
    blocks = asked.withColumn("block", F.explode(F.array(*(block("chunk_index") + d for d in (-1, 0, 1)))))
    rows = near.select("doc_id", F.col("chunk_index").alias("n"), "text", block("chunk_index").alias("block"))
    gathered = blocks.join(rows, ["doc_id", "block"]).groupBy("doc_id", "chunk_index").agg(F.collect_list(F.struct("n", "text")).alias("rows"))  # 3 blocks at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, at, rows in zip(b["doc_id"], b["chunk_index"], b["rows"]):
                texts = {r["n"]: r["text"] for r in rows}
                if at not in texts:
                    continue
                first = (at // width - 1) * width
                lo, hi, size, left = at, at, len(texts[at]), True
                while size < most:
                    for n in (lo - 1, hi + 1) if left else (hi + 1, lo - 1):
                        if n in texts and size + len(texts[n]) <= most + slack:
                            break
                    else:
                        break
                    size, lo, hi, left = size + len(texts[n]), min(lo, n), max(hi, n), not left
                whole = size >= most or lo > first and hi < first + 3 * width - 1
                out.append((doc, at, "\n\n".join(texts[n] for n in range(lo, hi + 1)), whole or lo == 0 and hi < first + 3 * width - 1))
            yield pd.DataFrame(out, columns=["doc_id", "chunk_index", "context", "whole"])

    return gathered.mapInPandas(run, "doc_id bigint, chunk_index int, context string, whole boolean")


# --- pages ---------------------------------------------------------------------------

# Lengths of probes in letters, the pages a chunk may span or jump, and shares of words.
PROBES, SHORT_CHUNK, MOST_SPAN, MOST_JUMP, LEAST_WORDS = (80, 50, 30), 20, 6, 20, 8
EXTENDS, WEAK, STRONG, ACCEPTED, BETTER = 0.4, 0.6, 0.8, 0.5, 0.3
_LONG_WORD = re.compile(r"[^\W\d_]{5,}")


def letters(text: str) -> str:
    return "".join(filter(str.isalpha, unicodedata.normalize("NFKC", text).casefold()))


def long_words(text: str) -> set[str]:
    return set(_LONG_WORD.findall(unicodedata.normalize("NFKC", text).casefold()))


class _Pages:
    """The letters and words of a paper's pages, counted from 1."""

    def __init__(self, texts: list[str]):
        plain = [letters(t) for t in texts]
        self.whole, self.n, self.texts = "".join(plain), len(texts), texts
        self.starts = [0, *accumulate(map(len, plain))][:-1]
        self._words: dict[int, set[str]] = {}

    def at(self, place: int) -> int:
        return max(1, bisect_right(self.starts, place))

    def words(self, page: int) -> set[str]:
        if page not in self._words:
            self._words[page] = long_words(self.texts[page - 1])
        return self._words[page]

    def share(self, words: set[str], first: int, last: int | None = None) -> float:
        """Share of the words that stand on the pages."""
        held = set().union(*(self.words(p) for p in range(first, (last or first) + 1)))
        return len(words & held) / len(words) if words else 0.0

    def best(self, words: set[str], first: int, last: int) -> tuple[int, float]:
        """The first page of the largest share."""
        return max(((p, self.share(words, p)) for p in range(first, last + 1)), key=lambda x: (x[1], -x[0]))

    def grown(self, words: set[str], first: int, last: int, back: bool) -> tuple[int, int]:
        """The span with the neighbouring pages that hold enough of the words."""
        while back and first > 1 and last - first < MOST_SPAN and self.share(words, first - 1) >= EXTENDS:
            first -= 1
        while last < self.n and last - first < MOST_SPAN and self.share(words, last + 1) >= EXTENDS:
            last += 1
        return first, last


def _probed(pages: _Pages, text: str, cursor: int, last: int | None) -> tuple[list | None, int, int | None]:
    """([first, last, status, whether the end was seen] or None, cursor, last page) by letters of a chunk."""
    body, whole = letters(text), pages.whole
    if len(body) < SHORT_CHUNK:
        return None, cursor, last
    sizes = [s for s in PROBES if len(body) >= s] + ([len(body)] if len(body) < 2 * PROBES[-1] else [])
    for size in sizes:
        place = whole.find(body[:size], cursor)
        ahead = place >= 0
        place = place if ahead else whole.find(body[:size])
        if place < 0:
            continue
        first, end = pages.at(place), None
        tail = next((s for s in PROBES if len(body) >= s + size), None)
        if tail is not None and (there := whole.find(body[-tail:], place + size)) >= 0 and 0 <= pages.at(there) - first <= MOST_SPAN:
            end = pages.at(there)
        far = end is None and last is not None and first - last > MOST_JUMP
        if far:  # text that is repeated later needs the words of the page on its side
            words = long_words(text)
            far = len(words) < LEAST_WORDS or pages.share(words, first) < STRONG
        if (ahead or end is not None) and not far:
            row = [first, end or first, "located", end is not None]
            return row, place if ahead else cursor, row[1] if ahead else last
        break
    seen = []
    for part in (0.25, 0.5, 0.75):
        at = int(len(body) * part)
        place = next((p for s in PROBES if at + s <= len(body) and (p := whole.find(body[at : at + s], cursor)) >= 0), -1)
        if place >= 0:
            seen.append(pages.at(place))
    if seen and max(seen) - min(seen) <= MOST_SPAN:
        return [min(seen), max(seen), "partial", True], cursor, last
    return None, cursor, last


def _between(rows: list[list | None], n: int) -> tuple[int | None, int | None]:
    """(last page of the placed chunk before, first page of the one after)."""
    placed = ("located", "partial")
    before = next((r[1] for r in reversed(rows[:n]) if r and r[2] in placed), None)
    after = next((r[0] for r in rows[n + 1 :] if r and r[2] in placed), None)
    return before, after


def map_pages(page_texts: list[str], chunks: list[str]) -> list[tuple[int | None, int | None, str]]:
    """(first page, last page, status) of each chunk in document order; pages count from 1.

    A chunk's head is looked for from the cursor on, then anywhere; its tail confirms the last
    page, else letters from its middle tell. Spans are grown, or moved, by the words they hold.
    What isn't found takes the page between its placed neighbours that holds most of its words,
    else lies between them. status: located, partial, interpolated, unlocated or no_text.
    """
    pages = _Pages(page_texts)
    if not pages.whole:
        return [(None, None, "no_text")] * len(chunks)
    rows: list[list | None] = []
    cursor, last = 0, None
    for text in chunks:
        row, cursor, last = _probed(pages, text, cursor, last)
        rows.append(row)
    words = [long_words(t) for t in chunks]
    for own, row in zip(words, rows):
        if row is None or len(own) < LEAST_WORDS:
            continue
        if row[2] == "located" and not row[3]:
            row[0], row[1] = pages.grown(own, row[0], row[1], back=False)
        held = pages.share(own, row[0], row[1])
        if held < WEAK:
            page, share = pages.best(own, 1, pages.n)
            if share >= STRONG and share >= held + BETTER:
                row[0], row[1] = pages.grown(own, page, page, back=True)
    for n, own in enumerate(words):
        if rows[n] is None and len(own) >= LEAST_WORDS:
            before, after = _between(rows, n)
            low, high = (before or after or 1), (after or before or pages.n)
            high = max(low, high)
            if before or after:
                low, high = max(1, low - 1), min(pages.n, high + 1)
            page, share = pages.best(own, low, high)
            if share >= ACCEPTED:
                rows[n] = [page, page, "partial", True]
    out = []
    for n, row in enumerate(rows):
        if row is None:
            before, after = _between(rows, n)
            low = before or after
            out.append((low, max(low, after or low), "interpolated") if low else (None, None, "unlocated"))
        else:
            out.append((row[0], row[1], row[2]))
    return out


def page_from_header(header: str = "section_header") -> Column:
    """The page number of a "Page N" section header of scanned texts, else null."""
    found = F.regexp_extract(F.coalesce(F.col(header), F.lit("")), r"^Page (\d+)$", 1)
    return F.when(found != "", found).cast("int")


def assign_pages(page_text: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, page_start, page_end, status) from page_text (doc_id, page_no, text)."""

    def run(key, p: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        p, c = p.sort_values("page_no"), c.sort_values("chunk_index")
        got = map_pages(p["text"].fillna("").tolist(), c["text"].fillna("").tolist())
        out = pd.DataFrame(got, columns=["page_start", "page_end", "status"])
        out.insert(0, "chunk_index", c["chunk_index"].to_numpy())
        out.insert(0, "doc_id", key[0])
        return out.astype({"page_start": "Int32", "page_end": "Int32"})

    schema = "doc_id bigint, chunk_index int, page_start int, page_end int, status string"
    held = chunks.join(page_text.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "chunk_index"])
    return page_text.groupBy("doc_id").cogroup(held.select("doc_id", "chunk_index", "text").groupBy("doc_id")).applyInPandas(run, schema)


def fill_pages(chunks: DataFrame) -> DataFrame:
    """Null pages from the nearest located chunk before, else after, in the document."""
    before = Window.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(1, Window.unboundedFollowing)
    last, first = F.last("page_end", ignorenulls=True).over(before), F.first("page_start", ignorenulls=True).over(after)
    return chunks.dropDuplicates(["doc_id", "chunk_index"]).select("doc_id", "chunk_index", F.coalesce("page_start", last, first).alias("page_start"))
