"""Predicates over the papers table: work queues, provenance, completeness, dashboards.

The published tables carry no enrichment or layout stamps; predicates that need one take
it as an optional column and treat a missing one as null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from paperlake.operators.works import has_ink

MAX_RETRIES = 3
CHARS_A_PAGE = 500
GAP_FIELDS = ("title", "authors", "year", "doi")


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def quarantined(most: int = MAX_RETRIES) -> Column:
    return F.coalesce("error_count", F.lit(0)) >= most


def source_like(pattern: str) -> Column:
    return F.coalesce(F.col("metadata_source").ilike(pattern), F.lit(False))


def is_bib() -> Column:
    return source_like("bib:%")


def is_manual() -> Column:
    return source_like("%manual%") & ~is_bib()


def is_miss() -> Column:
    return source_like("none:%")


def is_enriched() -> Column:
    return F.col("metadata_source").isNotNull() & ~is_miss()


def never_enriched() -> Column:
    return F.col("metadata_source").isNull()


def suspicious() -> Column:
    """Text was read but is too short for the pages; needs ``text_length`` joined."""
    return _flag("has_text") & _flag("needs_ocr") & (F.coalesce("page_count", F.lit(0)) > 0) & (F.coalesce("text_length", F.lit(0)) < F.col("page_count") * CHARS_A_PAGE)


NEEDS = {
    "text": lambda: ~_flag("has_text"), "markdown": lambda: ~_flag("has_markdown"), "embeddings": lambda: ~_flag("has_embeddings"),
    "ocr": lambda: _flag("needs_ocr"), "chunk_embeddings": lambda: ~_flag("has_chunk_embeddings"),
    "metadata": lambda: F.col("doi").isNull() | F.col("metadata_source").isNull(), "citekey": lambda: F.col("citekey").isNull(),
}
HAS = {
    "text": lambda: _flag("has_text"), "markdown": lambda: _flag("has_markdown"), "embeddings": lambda: _flag("has_embeddings"),
    "chunk_embeddings": lambda: _flag("has_chunk_embeddings"), "errors": lambda: F.coalesce("error_count", F.lit(0)) > 0, "citekey": lambda: F.col("citekey").isNotNull(),
}
IS = {
    "scanned": lambda: F.coalesce("is_scanned", F.lit(False)), "digital": lambda: ~F.coalesce("is_scanned", F.lit(True)), "suspicious": suspicious,
    "broken": quarantined, "metadata-suspect": lambda: _flag("metadata_suspect"), "encrypted": lambda: _flag("is_encrypted"),
    "enrich-miss": is_miss, "manual-metadata": is_manual, "bib-metadata": is_bib,
}


def condition(needs=(), has=(), is_=(), has_errors=False, exclude_quarantined=False, exclude_encrypted=False, stale_version: str | None = None) -> Column:
    """The conjunction of the named filters; unknown names are refused."""
    out: list[Column] = []
    for names, known, what in ((needs, NEEDS, "needs"), (has, HAS, "has"), (is_, IS, "is")):
        for name in names:
            if name not in known:
                raise ValueError(f"unknown filter {what}={name}; known: {', '.join(known)}")
            out.append(known[name]())
    if has_errors:
        out.append(HAS["errors"]())
    if exclude_quarantined:
        out.append(~quarantined())
    if exclude_encrypted:
        out.append(~_flag("is_encrypted"))
    if stale_version is not None:
        out.append(_flag("has_embeddings") & (F.col("embedding_model_version") != stale_version))
    return reduce(Column.__and__, out, F.lit(True))


def with_text_length(papers: DataFrame, paper_text: DataFrame) -> DataFrame:
    return papers.join(paper_text.select(F.col("paper_id").alias("id"), "text_length"), "id", "left")


def queue(papers: DataFrame, limit: int | None = None, **filters) -> DataFrame:
    """(id, filename) in work order; without a filter what needs text."""
    picked = papers.where(condition(**(filters or {"needs": ("text",)}))).select("id", "filename").orderBy("filename", "id")
    return picked.limit(limit) if limit is not None else picked


def count(papers: DataFrame, **filters) -> DataFrame:
    """One row: how many papers the queue of the same filters has."""
    return papers.where(condition(**(filters or {"needs": ("text",)}))).agg(F.count("*").alias("n"))


def pending(papers: DataFrame) -> DataFrame:
    """One row: how much work of each kind the next run would take."""
    ok, text = ~quarantined(), _flag("has_text")
    counts = {
        "needs_text": ~text & ~_flag("is_encrypted") & ok,
        "needs_embeddings": text & ~_flag("has_embeddings") & ok,
        "needs_chunk_embeddings": text & ~_flag("has_chunk_embeddings") & ok,
        "needs_enrich": never_enriched(), "enrich_misses": is_miss(), "metadata_suspect": _flag("metadata_suspect"),
        "manual_metadata": is_manual(), "bib_metadata": is_bib(),
        "needs_layout_title": F.col("title_from_layout").isNull() & ~_flag("is_encrypted"),
        "layout_titled": F.coalesce(F.col("title_from_layout") != "", F.lit(False)),
        "display_untitled": (F.coalesce("title", F.lit("")) == "") & (F.coalesce("title_from_layout", F.lit("")) == ""),
    }
    return papers.agg(*(F.count_if(c).alias(n) for n, c in counts.items()))


def status(papers: DataFrame) -> DataFrame:
    """One row: counts of the library's states and their percentages (0 for an empty library)."""
    flags = ("has_text", "has_markdown", "has_embeddings", "has_chunk_embeddings", "needs_ocr", "is_encrypted", "metadata_suspect")
    row = papers.agg(F.count("*").alias("total"), *(F.count_if(_flag(f)).alias(f) for f in flags), F.count_if(HAS["errors"]()).alias("errors"), F.count_if(quarantined()).alias("quarantined"))
    pct = lambda c: F.when(F.col("total") > 0, F.round(100.0 * F.col(c) / F.col("total"), 1)).otherwise(0.0)
    return row.select("*", pct("has_text").alias("pct_text"), pct("has_embeddings").alias("pct_embeddings"))


def is_empty(field: str) -> Column:
    if field == "year":
        return F.col("year").isNull()
    empty = F.coalesce(F.col(field), F.lit("")) == ""
    return empty | (F.col("authors") == "[]") if field == "authors" else empty


def completeness(papers: DataFrame) -> DataFrame:
    """(field, missing, never_attempted, provider_miss, attempted_incomplete, complete)."""
    fields = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(is_empty(f), F.lit(False)).alias("gap")) for f in GAP_FIELDS)))
    rows = papers.select(never_enriched().alias("never"), is_miss().alias("miss"), fields.alias("x")).select("never", "miss", "x.field", "x.gap")
    gap, never, miss = F.col("gap"), F.col("never"), F.col("miss")
    return rows.groupBy("field").agg(
        F.count_if(gap).alias("missing"), F.count_if(gap & never).alias("never_attempted"), F.count_if(gap & miss).alias("provider_miss"),
        F.count_if(gap & ~never & ~miss).alias("attempted_incomplete"), F.count_if(~gap).alias("complete"),
    )


def gaps(papers: DataFrame, field: str, attempted_only: bool = False) -> DataFrame:
    if field not in GAP_FIELDS:
        raise ValueError(f"unknown field {field}; known: {', '.join(GAP_FIELDS)}")
    found = papers.where(F.coalesce(is_empty(field), F.lit(False)))
    return (found.where(~never_enriched()) if attempted_only else found).select("id").orderBy("id")


def default_enrich(papers: DataFrame, retry_misses: bool = False) -> DataFrame:
    picked = never_enriched() | is_miss() if retry_misses else never_enriched()
    return papers.where(picked).select("id").orderBy("id")


def to_process(papers: DataFrame) -> DataFrame:
    return papers.where(~_flag("has_text") & ~_flag("is_scanned") & ~_flag("is_encrypted") & ~quarantined()).select("id")


def errors(papers: DataFrame) -> DataFrame:
    return papers.where("error_count > 0").select("id", "filename", "error_count").orderBy(F.desc("error_count"), "id")


def retry(papers: DataFrame, most: int = MAX_RETRIES) -> DataFrame:
    return papers.where((F.col("error_count") > 0) & (F.col("error_count") < most)).select("id").orderBy("id")


def missing_ids(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(id, pos) of asked ids (pos, id) that are not known, once each, in the order first asked."""
    return asked.join(known.select("id"), "id", "left_anti").groupBy("id").agg(F.min("pos").alias("pos"))


def resolve(asked: DataFrame, papers: DataFrame) -> DataFrame:
    """(ident, id): each identifier as id, file name or citekey, exact before case-blind, lowest id first."""
    by = [("1", F.col("id").cast("string"), False), ("2", F.col("filename"), False), ("3", F.col("citekey"), False), ("4", F.col("citekey"), True), ("5", F.col("filename"), True)]
    names = reduce(DataFrame.union, [papers.select(F.lit(int(p)).alias("tier"), (F.lower(c) if low else c).alias("key"), F.lit(low).alias("low"), "id") for p, c, low in by])
    keys = asked.select("ident", F.explode(F.array(F.struct(F.col("ident").alias("key"), F.lit(False).alias("low")), F.struct(F.lower("ident").alias("key"), F.lit(True).alias("low")))).alias("x")).select("ident", "x.*")
    found = keys.join(names, ["key", "low"])
    return found.groupBy("ident").agg(F.min(F.struct("tier", "id")).alias("m")).select("ident", F.col("m.id").alias("id"))


def display(papers: DataFrame) -> DataFrame:
    """(id, display_title, title_source): metadata, then layout, then file name."""
    title, layout = has_ink("title"), has_ink("title_from_layout")
    shown = F.when(title, F.col("title")).when(layout, F.col("title_from_layout")).otherwise(F.col("filename"))
    return papers.select("id", shown.alias("display_title"), F.when(title, "metadata").when(layout, "layout").otherwise("filename").alias("title_source"))
