"""Splitting oversized texts at natural boundaries, by recursive bisection.

A text over the limit is first cut between neighbouring blocks that cannot share a piece
(together over the limit); what still exceeds the limit minus the overlap is cut at the
strongest boundary near its midpoint, and the halves again. Then each piece but the first
is extended backwards by the overlap.

Blocks are parted by lines of nothing but white space; fenced code is one block whatever it
holds. All positions count code points.

Defined results: null and short texts are one piece (null text stays null); a text without
any boundary is cut between characters; repeated rows give one set of pieces; columns of
the input other than those named are ignored; an empty table gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

LIMIT, OVERLAP = 1800, 200
PART = 1_000  # chunks of a document that a task meets
KINDS = ("char", "word", "clause", "sentence", "line", "block", "forced")

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_WORD = re.compile(r"\s+(?=\S)")
_CLAUSE = re.compile(r"[,;:]['\"”’)\]]*\s+(?=\S)")
_SENTENCE = re.compile(r"[.!?…。！？]['\"”’)\]]*(?:\s+(?=\S)|(?<=[。！？]))")


def blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of every block, without the line end after it."""
    out, start, end, at, fence = [], None, 0, 0, ""
    for line in text.split("\n"):
        body = line.rstrip("\r")
        if fence:
            m = _FENCE.match(body)
            if m and m.group(1)[0] == fence[0] and len(m.group(1)) >= len(fence) and not body[m.end() :].strip():
                fence = ""
            end = at + len(body)
        elif not body.strip():
            if start is not None:
                out.append((start, end))
                start = None
        else:
            if start is None:
                start = at
            end = at + len(body)
            if m := _FENCE.match(body):
                fence = m.group(1)
        at += len(line) + 1
    if start is not None:
        out.append((start, end))
    return out


def boundaries(text: str, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, strengths) of every natural boundary, positions ascending."""
    strength: dict[int, int] = {}
    for level, pattern in ((1, _WORD), (2, _CLAUSE), (3, _SENTENCE)):
        for m in pattern.finditer(text):
            strength[m.end()] = level
    at = text.find("\n")
    while at >= 0:
        strength[at + 1] = 4
        at = text.find("\n", at + 1)
    found = blocks(text)
    for (a, _), (b, e) in zip(found, found[1:]):
        strength[b] = 6 if e - a > limit else 5
    strength.pop(0, None)
    strength.pop(len(text), None)
    pos = np.array(sorted(strength), np.int64)
    return pos, np.array([strength[p] for p in pos.tolist()], np.int8)


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """(position, kind of boundary) of every cut, ascending."""
    if len(text) <= limit:
        return []
    pos, level = boundaries(text, limit)
    room = limit - overlap
    forced = [int(p) for p in pos[level == 6]]
    out, ends = [(p, "forced") for p in forced], set(forced)
    todo = list(zip([0, *forced], [*forced, len(text)]))
    while todo:
        a, b = todo.pop()
        if b - a <= room or a == 0 and b - a <= limit and b in ends:
            continue
        mid, margin = (a + b) / 2, (b - a) / 4
        lo, hi = np.searchsorted(pos, [a + margin, b - margin], "left")
        if lo < hi:
            near = level[lo:hi]
            best = np.flatnonzero(near == near.max())
            k = lo + best[np.argmin(np.abs(pos[lo:hi][best] - mid))]
            cut, kind = int(pos[k]), KINDS[level[k]]
        else:
            cut, kind = int(mid), "char"
        out.append((cut, kind))
        todo += [(a, cut), (cut, b)]
    return sorted(out)


def split_items(
    df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, once: bool = True
) -> DataFrame:
    """(id, piece, start, end, cut_offset, cut_kind, text) of the pieces of every text over the limit.

    start and end bound the piece with its overlap; cut_offset, cut_kind tell where and at
    what boundary it was cut from the piece before (null for the first). once: repeated rows
    give one set of pieces; without it nothing is shuffled.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, text in zip(batch["id"], batch["text"]):
                where = cuts(text, limit, overlap)
                edges = [0, *(c for c, _ in where), len(text)]
                for n, (a, b) in enumerate(zip(edges, edges[1:])):
                    s = max(0, a - overlap) if n else 0
                    rows.append((i, n, s, b, a if n else None, where[n - 1][1] if n else None, text[s:b]))
            out = pd.DataFrame(rows, columns=["id", "piece", "start", "end", "cut_offset", "cut_kind", "text"])
            yield out.astype({"cut_offset": "Int64"})

    long = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    long = long.where(F.length("text") > limit)
    return (long.dropDuplicates() if once else long).mapInPandas(pieces, "id bigint, piece int, start bigint, end bigint, cut_offset bigint, cut_kind string, text string")


def right_offsets(chunks: DataFrame, paper_text: DataFrame) -> DataFrame:
    """(chunk_id, char_offset): where each chunk's text starts in its paper's markdown.

    A recorded offset that the markdown confirms is kept; else the first place of the text;
    null where the text isn't in the markdown. Without markdown a recorded offset is kept
    unless it is 0 in a later chunk.
    """
    c = chunks.select("chunk_id", "doc_id", "chunk_index", "text", "char_offset")
    m = paper_text.select(F.col("paper_id").alias("doc_id"), "markdown").where("markdown is not null and markdown <> ''")
    told = F.col("char_offset")
    there = F.substring(F.col("markdown"), (told + 1).cast("int"), F.length("text")) == F.col("text")
    place = F.expr("position(text in markdown)")
    right = (
        F.when(F.col("markdown").isNull(), F.when((told != 0) | (F.col("chunk_index") == 0), told))
        .when(there, told)
        .when(place > 0, (place - 1).cast("bigint"))
    )
    # a document of very many chunks is met in parts of PART chunks, so no task gets all of them
    part = F.coalesce(F.floor(F.col("chunk_index") / PART).cast("int"), F.lit(-1))
    c = c.withColumn("part", part)
    parts = m.join(c.select("doc_id", "part").distinct(), "doc_id")
    return c.join(parts, ["doc_id", "part"], "left").select("chunk_id", right.alias("char_offset"))


def split_chunks(chunks: DataFrame, paper_text: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every chunk over the limit with its header, pages and right char_offset."""
    long = chunks.where(F.length("text") > limit).dropDuplicates(["chunk_id", "text"])
    about = long.select(F.col("chunk_id").alias("id"), "doc_id", "chunk_index", "section_header", "page_start", "page_end")
    at = right_offsets(long, paper_text).select(F.col("chunk_id").alias("id"), F.col("char_offset").alias("base")).dropDuplicates(["id"])
    got = split_items(long, "chunk_id", "text", limit, overlap).join(about.dropDuplicates(["id"]), "id").join(at, "id", "left")
    return got.select(
        F.col("id").alias("chunk_id"), "doc_id", "chunk_index", "piece", "section_header", "page_start", "page_end",
        (F.col("base") + F.col("start")).alias("char_offset"), "cut_offset", "cut_kind", "text",
    )
