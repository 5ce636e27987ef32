"""From files to searchable papers: registering, extracting, chunking, embedding, and the whole chain.

Readers of PDFs, OCR and embedding models are given as functions; everything around them is
DataFrames. A step takes tables and gives tables with the outcome of every row, so one bad
file costs its row and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from paperlake.operators import chunking, queue, retrieval, search
from paperlake.operators.library import diff
from paperlake.plans.lineage import materialize
from paperlake.plans.numbering import numbered

Extractor = Callable[[str], tuple[str, str, list[str]]]  # path -> raw text, markdown, messages
RESET = ("has_text", "has_markdown", "has_embeddings")  # flags that a changed file loses
TEXT_COLUMNS = ("paper_id", "raw_text", "markdown", "text_length", "markdown_length")


@dataclass
class Library:
    """The tables that the steps work on."""

    papers: DataFrame
    paper_text: DataFrame
    chunks: DataFrame
    chunk_vec: DataFrame
    report: dict = field(default_factory=dict)


def _kept(df: DataFrame, columns: list[str], **values: Column) -> DataFrame:
    return df.select(*(values.get(c, F.col(c)).alias(c) for c in columns))


def _typed(df: DataFrame, like: DataFrame, **values: Column) -> DataFrame:
    """Rows with the columns of ``like``; what isn't given is null."""
    return df.select(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema.fields))


def ingest(papers: DataFrame, files: DataFrame, seen: DataFrame | None = None, now: Column | None = None) -> tuple[DataFrame, dict[str, int]]:
    """(papers, counts) after a scan of files (path, length, modified, hash[, pages, encrypted, kind]).

    New files get the next ids in the order of their paths; a changed file loses its text,
    markdown, document vector and layout title, but not its chunk vectors; a touched one only
    takes the new time. Missing files are counted and stay. seen (path) are listed files that
    could not be read: they are counted as evicted and not as missing.
    """
    now = F.current_timestamp().cast("timestamp_ntz") if now is None else now
    change = diff(files, papers)
    if seen is not None:
        gone = seen.join(files.select("path"), "path", "left_anti").select("path", F.lit(True).alias("evicted"))
        change = change.join(gone, "path", "left").withColumn("change", F.when(F.col("evicted") & (F.col("change") == "missing"), "evicted").otherwise(F.col("change"))).drop("evicted")
    change = materialize(change, "ingest")
    told = {r["change"]: r["count"] for r in change.groupBy("change").count().collect()}
    columns = [c for c in papers.columns]
    have = set(files.columns)
    new = files.join(change.where("change = 'new'"), "path", "left_semi")
    top = papers.agg(F.max("id")).first()[0] or 0
    fresh = numbered(new, ["path"], "id", top + 1)
    name = F.element_at(F.split("path", "/"), -1)
    scanned = F.when(F.col("kind").isNotNull(), F.col("kind") == "scanned") if "kind" in have else F.lit(None)
    made = _typed(
        fresh, papers, id=F.col("id"), path=F.col("path"), filename=name, file_hash=F.col("hash"), file_size=F.col("length"), file_modified=F.col("modified"),
        page_count=F.col("pages") if "pages" in have else F.lit(None), is_encrypted=F.col("encrypted") if "encrypted" in have else F.lit(False), is_scanned=scanned,
        needs_ocr=F.coalesce(scanned, F.lit(False)), has_text=F.lit(False), has_markdown=F.lit(False), has_embeddings=F.lit(False), has_chunk_embeddings=F.lit(False),
        metadata_suspect=F.lit(False), error_count=F.lit(0), indexed_at=now, updated_at=now,
    )
    f = files.select("path", F.col("hash").alias("_hash"), F.col("length").alias("_size"), F.col("modified").alias("_time"))
    old = papers.join(change, "path", "left").join(f, "path", "left")
    changed, moved = F.col("change") == "changed", F.col("change").isin("changed", "touched")
    values = {c: F.when(changed, F.lit(False)).otherwise(F.col(c)) for c in RESET if c in columns}
    values |= {"file_hash": F.when(changed, F.col("_hash")).otherwise(F.col("file_hash")), "file_size": F.when(moved, F.col("_size")).otherwise(F.col("file_size")), "file_modified": F.when(moved, F.col("_time")).otherwise(F.col("file_modified"))}
    for c in ("title_from_layout", "title_layout_confidence", "title_layout_at"):
        if c in columns:
            values[c] = F.when(~changed, F.col(c))
    if "updated_at" in columns:
        values["updated_at"] = F.when(moved, now).otherwise(F.col("updated_at"))
    return _kept(old, columns, **values).unionByName(made), {k: told.get(k, 0) for k in ("new", "changed", "touched", "unchanged", "missing", "evicted")}


def extract(papers: DataFrame, extractor: Extractor) -> DataFrame:
    """(id, raw_text, markdown, messages, error) of every paper's file; an exception becomes the row's error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, path in zip(b["id"], b["path"]):
                try:
                    raw, markdown, messages = extractor(path)
                    rows.append((i, raw, markdown, list(dict.fromkeys(messages)), None))
                except Exception as e:  # noqa: BLE001 - any failure of a reader is its row's error
                    rows.append((i, None, None, [], f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=["id", "raw_text", "markdown", "messages", "error"])

    return papers.select("id", "path").mapInPandas(run, "id bigint, raw_text string, markdown string, messages array<string>, error string")


def process(library: Library, extracted: DataFrame, ocr: bool = False, now: Column | None = None) -> Library:
    """The library with extracted texts (id, raw_text, markdown, error) put in.

    A text replaces the paper's old text and chunks, whose vectors go; the flags follow. A failure
    raises error_count and changes nothing else. ocr: the texts have "## Page N" sections, which
    give the chunks' pages, and the paper no longer needs OCR.
    """
    now = F.current_timestamp().cast("timestamp_ntz") if now is None else now
    done = materialize(extracted.dropDuplicates(["id"]).join(library.papers.select("id"), "id", "left_semi"), "extracted")
    good = done.where("error is null")
    ids = good.select(F.col("id").alias("paper_id"))
    rows = good.select(F.col("id").alias("paper_id"), "raw_text", "markdown", F.length("raw_text").alias("text_length"), F.length("markdown").alias("markdown_length"))
    text = library.paper_text.join(ids, "paper_id", "left_anti").unionByName(_typed(rows, library.paper_text, **{c: F.col(c) for c in TEXT_COLUMNS}))
    cut = chunking.chunk_documents(rows)
    page = chunking.page_from_header() if ocr else F.lit(None).cast("int")
    top = library.chunks.agg(F.max("chunk_id")).first()[0] or 0
    made = numbered(cut.withColumn("page_start", page), ["doc_id", "chunk_index"], "chunk_id", top + 1)
    old = library.chunks.join(ids.select(F.col("paper_id").alias("doc_id")), "doc_id", "left_semi").select("chunk_id")
    chunks = library.chunks.join(ids.select(F.col("paper_id").alias("doc_id")), "doc_id", "left_anti").unionByName(
        _typed(made.withColumn("page_end", F.col("page_start")), library.chunks, **{c: F.col(c) for c in ("chunk_id", "doc_id", "chunk_index", "section_header", "page_start", "page_end", "text", "char_offset")})
    )
    vectors = library.chunk_vec.join(old, "chunk_id", "left_anti")
    told = library.papers.join(done.select("id", F.col("error").alias("_error"), F.lit(True).alias("_tried")), "id", "left")
    ok, failed = F.col("_tried") & F.col("_error").isNull(), F.col("_error").isNotNull()
    ok = F.coalesce(ok, F.lit(False))
    flag = lambda c, v: F.when(ok, F.lit(v)).otherwise(F.col(c))
    values = {"has_text": flag("has_text", True), "has_markdown": flag("has_markdown", True), "has_chunk_embeddings": flag("has_chunk_embeddings", False), "error_count": F.when(failed, F.coalesce("error_count", F.lit(0)) + 1).otherwise(F.col("error_count"))}
    if ocr:
        values["needs_ocr"] = flag("needs_ocr", False)
    if "updated_at" in library.papers.columns:
        values["updated_at"] = F.when(F.col("_tried"), now).otherwise(F.col("updated_at"))
    counts = done.agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed")).first().asDict()
    return Library(_kept(told, library.papers.columns, **values), text, chunks, vectors, {**library.report, "ocr" if ocr else "process": counts})


def reset_errors(papers: DataFrame, ids: DataFrame) -> DataFrame:
    """Papers with the error counts of the given ids cleared, so default selections take them again."""
    told = papers.join(ids.select("id", F.lit(True).alias("_reset")).distinct(), "id", "left")
    return _kept(told, papers.columns, error_count=F.when(F.col("_reset"), F.lit(0)).otherwise(F.col("error_count")))


def embed(library: Library, embedder=search.hash_embedding, limit: int | None = None) -> Library:
    """The library with vectors for the chunks of papers that want them; a paper is done when all its chunks are."""
    wants = library.papers.where("has_text and not coalesce(has_chunk_embeddings, false)").where(~queue.quarantined()).select("id")
    wants = wants.orderBy("id").limit(limit) if limit is not None else wants
    chunks = library.chunks.join(wants.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    fresh = materialize(retrieval.embed_chunks(library.papers, chunks, embedder), "embedded")
    vectors = library.chunk_vec.join(fresh.select("chunk_id"), "chunk_id", "left_anti").unionByName(_typed(fresh, library.chunk_vec, chunk_id=F.col("chunk_id"), embedding=F.col("embedding")))
    whole = retrieval.embedded_flags(chunks, fresh.where("embedding is not null")).where("complete").select(F.col("doc_id").alias("id"), F.lit(True).alias("_done"))
    papers = library.papers.join(whole, "id", "left")
    return Library(_kept(papers, library.papers.columns, has_chunk_embeddings=F.coalesce("_done", "has_chunk_embeddings")), library.paper_text, library.chunks, vectors, {**library.report, "embedded": whole.count()})


def pipeline(library: Library, files: DataFrame, extractor: Extractor, enricher: Callable[[DataFrame, DataFrame], DataFrame] | None = None, embedder=search.hash_embedding, filename: str | None = None, limit: int | None = None, dry_run: bool = False, refresh: dict | None = None) -> Library:
    """Ingest, process, enrich if asked, embed, refresh ledgers: the report has the counts of each stage.

    filename: only this file after the ingest. limit: papers of a stage. enricher(papers,
    paper_text) gives rows as ``metadata.enrich``. refresh: name to a ledger's refresh(papers).
    """
    papers, counts = ingest(library.papers, files)
    report = {"ingest": counts}
    if dry_run:
        return Library(library.papers, library.paper_text, library.chunks, library.chunk_vec, report)
    library = Library(materialize(papers, "papers"), library.paper_text, library.chunks, library.chunk_vec, report)
    todo = queue.to_process(library.papers) if filename is None else library.papers.where((F.col("filename") == filename) & ~F.coalesce("has_text", F.lit(False))).select("id")
    todo = todo.orderBy("id").limit(limit) if limit is not None else todo
    library = process(library, extract(library.papers.join(todo, "id", "left_semi"), extractor))
    library.papers = materialize(library.papers, "papers")
    if enricher is not None:
        untitled = library.papers.where("coalesce(title, '') = '' and coalesce(has_chunk_embeddings, false)").select("id")
        found = materialize(enricher(library.papers, library.paper_text), "enriched")
        library.papers = enriched(library.papers, found)
        titled = found.where("coalesce(title, '') <> ''").join(untitled, "id", "left_semi")
        library.report |= {"enriched": found.where("title is not null").count(), "titled_after_embed": titled.count()}
    library = embed(library, embedder, limit)
    for name, again in (refresh or {}).items():
        try:
            library.report[name] = again(library.papers)
        except Exception as e:  # noqa: BLE001 - a ledger never fails the pipeline
            library.report[name] = {"error": str(e)}
    return library


def enriched(papers: DataFrame, found: DataFrame) -> DataFrame:
    """Papers with enrichment rows (id, title, authors, year, doi, metadata_source, suspect) put in; a miss only marks."""
    f = found.select("id", *(F.col(c).alias(f"_{c}") for c in ("title", "authors", "year", "doi", "metadata_source", "suspect")))
    told = papers.join(f, "id", "left")
    hit = F.col("_title").isNotNull()
    values = {c: F.when(hit, F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in ("title", "doi", "authors", "year")}
    values["metadata_source"] = F.coalesce("_metadata_source", "metadata_source")
    values["metadata_suspect"] = F.when(hit, F.col("_suspect")).otherwise(F.col("metadata_suspect"))
    return _kept(told, papers.columns, **values)


def page_backfill(chunks: DataFrame, page_text: DataFrame, papers: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(chunks with pages, (doc_id, filename, chunks, located, partial, interpolated, unlocated, no_text) of mapped papers).

    Papers with a chunk that lacks its first page are mapped (all, if forced); chunks that carry
    a page header of scanned texts take the page from it. Only the page columns change.
    """
    open_docs = (chunks if force else chunks.where("page_start is null")).select("doc_id").distinct()
    own = chunks.join(open_docs, "doc_id", "left_semi")
    headed = own.groupBy("doc_id").agg(F.max(chunking.page_from_header()).alias("m")).where("m is not null").select("doc_id")
    by_header = own.join(headed, "doc_id", "left_semi").select("doc_id", "chunk_index", chunking.page_from_header().alias("new_start")).distinct()
    by_header = by_header.select("doc_id", "chunk_index", "new_start", F.col("new_start").alias("new_end"), F.when(F.col("new_start").isNull(), "unlocated").otherwise("located").alias("status"))
    mapped = chunking.assign_pages(page_text, own.join(headed, "doc_id", "left_anti")).select("doc_id", "chunk_index", F.col("page_start").alias("new_start"), F.col("page_end").alias("new_end"), "status")
    placed = materialize(by_header.unionByName(mapped), "pages")
    out = chunks.join(placed, ["doc_id", "chunk_index"], "left")
    out = out.select(*(F.when(F.col("new_start").isNotNull(), F.col("new_start" if c == "page_start" else "new_end")).otherwise(F.col(c)).alias(c) if c in ("page_start", "page_end") else F.col(c) for c in chunks.columns))
    kinds = ("located", "partial", "interpolated", "unlocated", "no_text")
    report = placed.groupBy("doc_id").agg(F.count("*").alias("chunks"), *(F.count_if(F.col("status") == k).alias(k) for k in kinds))
    names = papers.select(F.col("id").alias("doc_id"), "filename")
    worst = (F.col("unlocated") + F.col("interpolated") + F.col("no_text")) / F.col("chunks")
    return out, report.join(names, "doc_id", "left").orderBy(F.desc(worst), "doc_id")
