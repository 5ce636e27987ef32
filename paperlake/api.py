"""The library as one object: reading methods return DataFrames, changes return the changed tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paperlake.operators import chunking, find, frontmatter, grep, layout, library, link, metadata, process, queue, repairs, retrieval, search, works
from paperlake.operators.collections import Collections
from paperlake.operators.inbox import Inbox
from paperlake.operators.index import KeywordIndex, index_of
from paperlake.plans.catalog import Catalog
from paperlake.sources import providers, sinks
from paperlake.sources.tables import table

hash_embedding = search.hash_embedding
Embed = Callable[[str], list[float]]


class Library:
    """A folder of library tables. ``embed`` turns a query into a vector of the chunks' kind; ledgers is a catalog's folder."""

    def __init__(self, spark: SparkSession, root: str, embed: Embed | None = None, ledgers: str | None = None, now: Column | None = None):
        self.spark, self.root, self.embed, self.now = spark, root, embed, now
        self.catalog = Catalog(spark, ledgers or f"{root}/ledgers")

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.root, name)

    papers = property(lambda self: self.table("papers"))
    bib = property(lambda self: self.table("bib"))
    paper_text = property(lambda self: self.table("paper_text"))
    chunks = property(lambda self: self.table("chunks"))
    chunk_vec = property(lambda self: self.table("chunk_vec"))

    def ids(self, *ids: int) -> DataFrame:
        return self.spark.createDataFrame([(int(i),) for i in ids], "id bigint")

    # --- search

    @cached_property
    def texts(self) -> DataFrame:
        """(doc_id, text): file name, title, authors and text of every paper that has a text."""
        text = self.paper_text.where("raw_text is not null").select(F.col("paper_id").alias("id"), "raw_text")
        whole = F.concat_ws("\n", "filename", F.coalesce(F.when(works.has_ink("title"), F.col("title")), F.col("title_from_layout")), "authors", "raw_text")
        return self.papers.join(text, "id").select(F.col("id").alias("doc_id"), whole.alias("text"))

    @cached_property
    def index(self) -> KeywordIndex:
        """The keyword index over ``texts``, built at the first search."""
        return index_of(self.spark, self.texts, "doc_id", "text", f"{self.root}/library")

    def rebuild_index(self) -> KeywordIndex:
        return self.index.rebuild(search.tokenized(self.texts, "doc_id", "text"))

    def _query(self, query: str) -> DataFrame:
        return self.spark.createDataFrame([(0, [float(x) for x in self.embed(query)])], "q_idx bigint, qvec array<float>")

    def _near(self, query: str, restrict: DataFrame | None, k: int | None) -> DataFrame:
        chunks = self.chunks if restrict is None else self.chunks.join(restrict.select("doc_id").distinct(), "doc_id", "left_semi")
        return retrieval.chunk_scores(chunks, self.chunk_vec, self._query(query), len(self.embed(query)), None if restrict is not None else k)

    def search(self, query: str, limit: int = 20, restrict: DataFrame | None = None, syntax: bool = False, stem: bool = False, keyword_only: bool = False, fold_works: bool = False) -> retrieval.Outcome:
        """Keyword search, fused with the best chunk of each paper if there is an embedder; with snippets.

        restrict has doc_id. syntax: the query is of the index syntax over the columns filename, title, authors, text.
        """

        def keyword() -> DataFrame:
            if syntax:
                title = F.coalesce(F.when(works.has_ink("title"), F.col("title")), F.col("title_from_layout"))
                rows = self.papers.join(self.paper_text.select(F.col("paper_id").alias("id"), "raw_text"), "id")
                found = search.syntax_matches(search.fielded(rows, "id", filename=F.col("filename"), title=title, authors=F.col("authors"), text=F.col("raw_text")), query)
                return search.ranked(found, 2 * limit, restrict)
            if stem:
                return search.bm25(search.stemmed(search.tokenized(self.texts, "doc_id", "text")), search.stem_query(query), 2 * limit, restrict)
            return search.bm25(self.index, query, 2 * limit, restrict)

        near = self._near(query, restrict, max(20 * limit, 200)) if self.embed else None
        vector = None
        if near is not None:
            best = near.groupBy("doc_id").agg(F.max("score").alias("score"))
            vector = retrieval.vector_leg(best.limit(0), best, 2 * limit)
        got = retrieval.run(keyword, lambda: search.matches(self.index, query).count(), vector, limit, keyword_only, restrict is not None)
        results = search.folded(got.results, self.works().withColumnRenamed("id", "doc_id"), limit) if fold_works else got.results
        return retrieval.Outcome(got.mode, retrieval.with_snippets(results, self.chunks, self.paper_text, query, near), got.total, got.error)

    def semantic(self, query: str, limit: int = 10, documents: DataFrame | None = None, documents_only: bool = False) -> retrieval.Outcome:
        """Search by vectors alone; documents (doc_id, score) are scored document vectors, if there are any."""
        none = self.spark.createDataFrame([], "doc_id bigint, score double")
        return retrieval.semantic(none if documents is None else documents, None if documents_only else self._near(query, None, 100), limit, documents_only)

    def batch(self, queries: DataFrame, limit: int = 20) -> DataFrame:
        """Many queries (q_idx, q) in one job."""
        return self.index.batch(queries, limit)

    def find(self, fragment: str, limit: int = 20) -> DataFrame:
        return find.find(self.papers, fragment, limit)

    def grep(self, needle: str, ignore_case: bool = False, limit: int = 50, ids: DataFrame | None = None) -> tuple[DataFrame, bool, DataFrame | None]:
        """(places, whether there are more, asked ids (id) without any), in chunks and in texts without chunks."""
        rows = grep.searched(self.chunks, self.paper_text)
        asked = None if ids is None else ids.select(F.col("id").alias("doc_id"))
        rows = rows if asked is None else rows.join(asked.distinct(), "doc_id", "left_semi")
        return grep.report(grep.grep(rows, needle, ignore_case), limit, asked)

    def info(self, ids: DataFrame, query: str | None = None) -> DataFrame:
        return retrieval.info(ids, self.papers, self.paper_text, self.chunks, query)

    def read(self, ids: DataFrame) -> DataFrame:
        return retrieval.full_text(ids, self.paper_text)

    def read_chunks(self, first: int, last: int) -> DataFrame:
        return chunking.chunks_between(self.chunks, first, last)

    def context(self, asked: DataFrame) -> DataFrame:
        return chunking.context(self.chunks, asked)

    def resolve(self, asked: DataFrame) -> DataFrame:
        return queue.resolve(asked, self.papers)

    def works(self) -> DataFrame:
        return works.works(self.papers)

    def collapse(self, results: DataFrame, limit: int = 20) -> DataFrame:
        return search.folded(results, self.works().withColumnRenamed("id", "doc_id"), limit)

    # --- work to do

    def queue(self, limit: int | None = None, **filters) -> DataFrame:
        return queue.queue(queue.with_text_length(self.papers, self.paper_text), limit, **filters)

    def queue_count(self, **filters) -> int:
        return queue.count(queue.with_text_length(self.papers, self.paper_text), **filters).first()["n"]

    def status(self) -> DataFrame:
        return queue.status(self.papers)

    def pending(self) -> DataFrame:
        return queue.pending(self.papers)

    def errors(self) -> DataFrame:
        return queue.errors(self.papers)

    def retry(self, ids: DataFrame | None = None) -> DataFrame:
        """(id) to try again: those below the limit, or the given ones whatever their count."""
        return queue.retry(self.papers) if ids is None else self.papers.join(ids.select("id"), "id", "left_semi").select("id")

    def gaps(self, field: str, attempted_only: bool = False) -> DataFrame:
        return queue.gaps(self.papers, field, attempted_only)

    def completeness(self) -> DataFrame:
        return queue.completeness(self.papers)

    def schema(self) -> DataFrame:
        return library.describe({n: self.table(n) for n in ("papers", "paper_text", "bib", "chunks", "chunk_vec", "opens")})

    # --- ingest

    def tables(self) -> process.Library:
        return process.Library(self.papers, self.paper_text, self.chunks, self.chunk_vec)

    def ingest(self, files: DataFrame, seen: DataFrame | None = None) -> tuple[DataFrame, dict]:
        return process.ingest(self.papers, files, seen, self.now)

    def process(self, extractor: process.Extractor, ids: DataFrame | None = None) -> process.Library:
        todo = queue.to_process(self.papers) if ids is None else ids
        return process.process(self.tables(), process.extract(self.papers.join(todo.select("id"), "id", "left_semi"), extractor), now=self.now)

    def ocr(self, extractor: process.Extractor, ids: DataFrame | None = None) -> process.Library:
        todo = self.papers.where("coalesce(needs_ocr, false)").select("id") if ids is None else ids
        return process.process(self.tables(), process.extract(self.papers.join(todo.select("id"), "id", "left_semi"), extractor), ocr=True, now=self.now)

    def embed_chunks(self, embedder=hash_embedding, limit: int | None = None) -> process.Library:
        return process.embed(self.tables(), embedder, limit)

    def pipeline(self, files: DataFrame, extractor: process.Extractor, **options) -> process.Library:
        """The whole chain; the ledgers' keys are brought up to date where there are ledgers."""
        refresh = {n: x.refresh for n, x in (("collections", self.collections), ("inbox", self.inbox)) if self.catalog.has(x.table)}
        return process.pipeline(self.tables(), files, extractor, refresh=refresh, **options)

    def prune(self, files: DataFrame) -> tuple[DataFrame, ...]:
        return library.prune(self.papers, files, (self.paper_text, "paper_id"), (self.chunks, "doc_id"))

    def backfill_pages(self, page_text: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
        return process.page_backfill(self.chunks, page_text, self.papers, force)

    def backfill_titles(self, spans: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
        return layout.backfill_titles(self.papers, spans, self.paper_text, force)

    # --- metadata and links

    def enrich(self, provider: str, retry_misses: bool = False) -> DataFrame:
        name, records = providers.get(self.spark, provider)
        return metadata.enrich(self.papers, records, self.paper_text, name, retry_misses=retry_misses)

    def verify(self, threshold: float = metadata.CONTAINED) -> DataFrame:
        return metadata.verify(self.papers, self.paper_text, threshold)

    def set_metadata(self, changes: DataFrame, by: str, fields: list[str]) -> DataFrame:
        return metadata.set_by(self.papers, changes, by, fields)

    def clear_metadata(self, ids: DataFrame, citekey_too: bool = False) -> DataFrame:
        return metadata.cleared(self.papers, ids, citekey_too)

    def normalize(self, timestamps: tuple[str, ...] = (), all_orphans: bool = False) -> tuple[DataFrame, DataFrame]:
        return repairs.repaired(self.papers, timestamps, all_orphans)

    def title_guesses(self) -> DataFrame:
        return frontmatter.title_guesses(self.paper_text)

    def match_bib(self) -> DataFrame:
        return link.reconcile(self.papers, self.bib)

    def apply_matches(self, matches: DataFrame, include_uncertain: bool = False, force: bool = False) -> DataFrame:
        return link.apply_matches(self.papers, matches, self.bib, include_uncertain, force)

    def suggest(self) -> DataFrame:
        return link.suggest(self.papers, self.bib, self.paper_text)

    def apply_suggestions(self, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        return link.apply_suggestions(self.papers, self.suggest(), asked)

    def audit(self) -> DataFrame:
        return metadata.audit(self.papers, self.bib, self.paper_text)

    def clear_audited(self, asked: DataFrame, log_path: str) -> tuple[DataFrame, DataFrame]:
        return link.clear_audited(self.papers, self.audit(), asked, log_path)

    def pull(self) -> DataFrame:
        return link.pull(self.papers, self.bib, self.paper_text)

    def missing(self) -> DataFrame:
        return link.missing(self.bib, self.papers)

    def export_bib(self, path: str, prefix: str = "") -> None:
        sinks.write_text(link.bib_entries(self.papers, prefix).select("entry"), path)

    def append_bib(self, path: str, ids: DataFrame, prefix: str = "") -> DataFrame:
        """Papers with the keys of the entries that were appended to the folder of .bib text."""
        entries, out = link.append_entries(self.papers, self.bib, ids, prefix)
        sinks.write_text(entries.select("entry"), path, append=True)
        return out

    def vault(self, notes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(references, references without a paper, papers without a note) of notes (note, text)."""
        return library.references(notes), library.orphans(notes, self.papers), library.uncovered(notes, self.papers)

    # --- ledgers

    @property
    def collections(self) -> Collections:
        return Collections(self.catalog, self.now)

    @property
    def inbox(self) -> Inbox:
        return Inbox(self.catalog, self.now)

    def state_for(self, ids: DataFrame) -> DataFrame:
        return self.inbox.state_for(ids, self.papers)

    def collections_for(self, ids: DataFrame) -> DataFrame:
        return self.collections.collections_for(ids, self.papers)
