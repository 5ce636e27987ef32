"""Verbatim quotes: exact places of a needle, and places that agree up to line breaks and marks.

A column prefilter keeps rows that can match; only those reach Python. Repeated hits in the
overlap of neighbouring chunks are dropped by a join with the chunk before.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

_MARKS = frozenset("*_`~#­​‌‍⁠﻿")
_PLAIN = {"‘": "'", "’": "'", "‚": "'", "“": '"', "”": '"', "„": '"', "–": "-", "—": "-", "‐": "-", "‑": "-", "−": "-"}
_LIGATURE = re.compile("ff|fi|fl")


def normal(text: str, ignore_case: bool = False) -> tuple[str, list[int]]:
    """The text for comparison and, for each of its characters, the place it comes from."""
    out, places, i, n = [], [], 0, len(text)
    while i < n:
        c = text[i]
        if text.startswith(("<br>", "<br/>", "<br />"), i):
            c, step = " ", text.index(">", i) + 1 - i
        else:
            step = 1
        if c.isspace():
            if out and out[-1] != " ":
                out.append(" ")
                places.append(i)
        elif c in _MARKS:
            pass
        elif _PLAIN.get(c, c) == "-" and 0 < i < n - 1 and text[i - 1].isalnum() and (m := re.match(r"\s*(?=\w)", text[i + 1 :])):
            step += m.end()
        else:
            for x in unicodedata.normalize("NFKC", _PLAIN.get(c, c)):
                x = x.casefold() if ignore_case else x
                out += x
                places += [i] * len(x)
        i += step
    return "".join(out), places


def spans(text: str, needle: str, ignore_case: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, exact or normalized) of every place; normalized only where no exact place is."""
    if not needle:
        return []
    hay, want = (text.lower(), needle.lower()) if ignore_case and len(text.lower()) == len(text) else (text, needle)
    out, at = [], hay.find(want)
    while at >= 0:
        out.append((at, at + len(needle), "exact"))
        at = hay.find(want, at + (len(want) if ignore_case else 1))
    if out:
        return out
    hay, places = normal(text, ignore_case)
    want = normal(needle, ignore_case)[0].strip()
    at = hay.find(want) if want else -1
    while at >= 0:
        out.append((places[at], places[at + len(want) - 1] + 1, "normalized"))
        at = hay.find(want, at + len(want))
    return out


def fragments(needle: str) -> list[str]:
    parts = [p for w in re.findall(r"[^\W_]+", needle) for p in _LIGATURE.split(w) if len(p) >= 3]
    return sorted(dict.fromkeys(parts), key=lambda p: (-len(p), p))[:3]


def can_match(needle: str, column: str = "text") -> Column:
    """Contains the needle, or two of its three longest fragments (one, if it has fewer)."""
    parts = fragments(needle)
    if not parts:
        return F.lit(True)
    low = F.lower(column)
    count = sum((F.when(low.contains(p.lower()), 1).otherwise(0) for p in parts), F.lit(0))
    return F.col(column).contains(needle) | (count >= min(2, len(parts)))


def grep_exact(rows: DataFrame, needle: str, ignore_case: bool = False) -> DataFrame:
    """(doc_id, chunk_index, start): first exact place of the needle in each row."""
    text = F.lower("text") if ignore_case else F.col("text")
    place = F.instr(text, needle.lower() if ignore_case else needle)
    return rows.select("doc_id", "chunk_index", (place - 1).cast("bigint").alias("start")).where("start >= 0")


def grep(rows: DataFrame, needle: str, ignore_case: bool = False, context: int = 80, overlap: int = 200) -> DataFrame:
    """(doc_id, chunk_index, start, end, kind, matched, context) over rows (doc_id, chunk_index, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [
                (d, c, s, e, k, t[s:e], t[max(0, s - context) : e + context])
                for d, c, t in zip(b["doc_id"], b["chunk_index"], b["text"])
                for s, e, k in spans(t, needle, ignore_case)
            ]
            yield pd.DataFrame(out, columns=["doc_id", "chunk_index", "start", "end", "kind", "matched", "context"])

    picked = rows.where(F.col("text").isNotNull() & can_match(needle)).select("doc_id", "chunk_index", "text").distinct()
    schema = "doc_id bigint, chunk_index int, start bigint, end bigint, kind string, matched string, context string"
    found = picked.mapInPandas(run, schema)
    # a hit that starts in the overlap with the chunk before is one that chunk has too; only hits near a
    # chunk's start ask for the chunk before, by an equi-join, so no task gets all hits of a document
    near = found.where(F.col("start") < overlap).select("doc_id", "chunk_index", "start", "end").join(picked, ["doc_id", "chunk_index"])
    ahead = near.select("doc_id", "chunk_index", "start", F.expr("substring(text, 1, end)").alias("opening"), (F.col("chunk_index") - 1).alias("before"))
    held = picked.join(found.select("doc_id", "chunk_index").distinct(), ["doc_id", "chunk_index"], "left_semi")
    before = held.select("doc_id", F.col("chunk_index").alias("before"), F.expr(f"right(text, {2 * overlap})").alias("closing"))
    again = ahead.join(before, ["doc_id", "before"]).where(F.expr("contains(closing, opening)")).select("doc_id", "chunk_index", "start").distinct()
    return found.join(again, ["doc_id", "chunk_index", "start"], "left_anti").select(*found.columns).orderBy("doc_id", "chunk_index", "start")


def searched(chunks: DataFrame, paper_text: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, text): chunks, and whole raw texts (chunk_index null) of papers without chunks."""
    cut = chunks.where("text is not null").select("doc_id", "chunk_index", "text").distinct()
    whole = paper_text.select(F.col("paper_id").alias("doc_id"), F.lit(None).cast("int").alias("chunk_index"), F.col("raw_text").alias("text"))
    return cut.unionByName(whole.where("text is not null and text <> ''").join(chunks.select("doc_id").distinct(), "doc_id", "left_anti"))


def report(hits: DataFrame, limit: int = 50, asked: DataFrame | None = None) -> tuple[DataFrame, bool, DataFrame | None]:
    """(the first hits, whether there are more, asked ids (doc_id) without any)."""
    first = hits.orderBy("doc_id", "chunk_index", "start").limit(limit)
    more = hits.limit(limit + 1).count() > limit
    return first, more, None if asked is None else asked.select("doc_id").distinct().join(hits, "doc_id", "left_anti")


def any_of(needles: list[str], column: str = "text") -> Column:
    return reduce(Column.__or__, [F.col(column).contains(n) for n in needles])
