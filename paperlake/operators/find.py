"""Known-item lookup: every word of a fragment in title, authors, citekey, DOI, year or file name."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from paperlake.functions.fold import unmarked

# Words that only glue author lists, edge punctuation, DOI prefixes.
GLUE = frozenset(("&", "and", "et", "al", "etal", "+"))
EDGE = " \t.,;:()[]{}\"'`?!"
DOI_STARTS = ("https://doi.org/", "http://doi.org/", "https://dx.doi.org/", "http://dx.doi.org/", "doi.org/", "doi:")
FIELDS = ("title", "title_from_layout", "authors", "citekey", "year", "doi", "filename")


_WORD = re.compile(rf"(?i)(?:{'|'.join(map(re.escape, DOI_STARTS))})?(\S+)")


def folded_text(text: str | None) -> str | None:
    return None if text is None else unmarked(text).casefold()


@pandas_udf(T.StringType())
def fold_column(texts: pd.Series) -> pd.Series:
    return texts.map(folded_text)


def words_of(fragment: str) -> list[str]:
    """Folded words that are asked for; words that only glue names count where there is nothing else."""
    told: dict[bool, list[str]] = {True: [], False: []}
    for piece in _WORD.findall(fragment):
        word = folded_text(piece.strip(EDGE).removeprefix("@"))
        if word:
            told[word not in GLUE].append(word)
    return told[True] or told[False]


def find(papers: DataFrame, fragment: str, limit: int = 20, ascii_only: bool = False) -> DataFrame:
    """(id, tier, matched_fields) ordered by tier, file name, id.

    Tier 0: the whole fragment in the title; 1: all words in the title, or the fragment in
    the layout title; 2: all words in bibliographic fields; 3: a file name or DOI helped.
    ``ascii_only`` folds case only, without leaving the JVM.
    """
    words, phrase = words_of(fragment), " ".join(words_of(fragment))
    fold = (lambda c: F.lower(c)) if ascii_only else fold_column
    text = {f: F.coalesce(fold(F.col(f)), F.lit("")) for f in FIELDS if f != "year"}
    rows = papers.select("id", F.col("filename").alias("_name"), F.col("year").cast("string").alias("year"), *(c.alias(f) for f, c in text.items()))
    inside = lambda f, w: F.coalesce(F.col("year") == w, F.lit(False)) if f == "year" else F.col(f).contains(w)
    every = lambda fields: reduce(Column.__and__, [reduce(Column.__or__, [inside(f, w) for f in fields]) for w in words])
    if not words:
        return rows.limit(0).select("id", F.lit(0).alias("tier"), F.lit("").alias("matched_fields"))
    tier = F.when(F.col("title").contains(phrase), 0).when(every(["title"]) | F.col("title_from_layout").contains(phrase), 1)
    tier = tier.when(every([f for f in FIELDS if f not in ("doi", "filename")]), 2).otherwise(3)
    used = F.array_join(F.array_compact(F.array(*(F.when(reduce(Column.__or__, [inside(f, w) for w in words]), F.lit(f)) for f in FIELDS))), ",")
    return rows.where(every(FIELDS)).select("id", tier.alias("tier"), used.alias("matched_fields"), "_name").orderBy("tier", "_name", "id").limit(limit).drop("_name")
