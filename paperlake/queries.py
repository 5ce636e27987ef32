"""The driver-facing queries of the core; their SQL twins are in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperlake.operators import chunking, collections, find, frontmatter, grep, identity, inbox, ledger, library, link, metadata, process, queue, repairs, retrieval, search, works
from paperlake.operators.components import components
from paperlake.operators.index import KeywordIndex, index_of
from paperlake.operators.unpack import unpack
from paperlake.oracles import ORACLES
from paperlake.plans.lineage import materialize
from paperlake.sources import sinks
from paperlake.sources.tables import table
from paperlake.streaming.opens import hourly

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
NEEDLE = "has rarely asked who records the"
KEYWORDS = "glacier OR permafrost OR monsoon"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def docs(s: SparkSession, d: str) -> DataFrame:
    return search.tokenized(table(s, d, "documents"), "doc_id", "text")


def idx(s: SparkSession, d: str) -> KeywordIndex:
    """The keyword index of the documents, built at the first query of a session."""
    return index_of(s, table(s, d, "documents"), "doc_id", "text", f"{d}/documents")


def english(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("lang = 'en'").select("doc_id")


def papers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "papers")


def vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def ask(s: SparkSession, d: str, ids: str) -> DataFrame:
    """Stated vector queries: the vectors of the given rows."""
    return table(s, d, "embeddings").where(ids).select(F.col("vec_id").alias("q_idx"), F.col("embedding").alias("qvec"))


def first_scores(s: SparkSession, d: str) -> DataFrame:
    return search.scores(vectors(s, d), ask(s, d, "vec_id = 0"))


def labelled_scores(s: SparkSession, d: str) -> DataFrame:
    return first_scores(s, d).join(vectors(s, d).select("id", "label"), "id")


@query
def p6_found(s: SparkSession, d: str) -> DataFrame:
    """One row per name packed in papers.authors and bib.authors."""
    left = unpack(papers(s, d), "id", "authors").select(F.lit("papers.authors").alias("field"), "*")
    right = unpack(table(s, d, "bib"), "entry_id", "authors").select(F.lit("bib.authors").alias("field"), "*")
    return left.unionByName(right)


# --- keyword search ---


@query
def fts_bm25_topk(s, d):
    return search.bm25(idx(s, d), KEYWORDS)


@query
def fts_bool_and_not(s, d):
    return search.bm25(idx(s, d), "referendum ballot NOT petition")


@query
def fts_phrase(s, d):
    return search.bm25(idx(s, d), '"as figure 10 shows"')


@query
def fts_prefix(s, d):
    return search.bm25(idx(s, d), "delib*")


@query
def fts_page_normalized(s, d):
    return search.page_normalized(search.bm25(idx(s, d), KEYWORDS))


@query
def fts_count(s, d):
    return search.matches(idx(s, d), KEYWORDS).agg(F.count("*").alias("matches"))


@query
def fts_restricted(s, d):
    return search.bm25(idx(s, d), KEYWORDS, restrict=english(s, d))


@query
def fts_multi_query(s, d):
    items = table(s, d, "eval_items").where("text is not null").select(F.col("item_id").alias("q_idx"), F.col("text").alias("q"))
    return idx(s, d).batch(items, limit=5)


@query
def fts_stemmed(s, d):
    return search.bm25(search.stemmed(docs(s, d)), search.stem_query("deliberations OR legitimacies"))


@query
def search_snippets(s, d):
    found = search.bm25(idx(s, d), KEYWORDS)
    return search.snippets(found, table(s, d, "documents").select("doc_id", "text"), KEYWORDS)


@query
def index_postings(s, d):
    return idx(s, d).postings().groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query
def corpus_stats(s, d):
    return search.corpus_stats(docs(s, d))


# --- vector search and fusion ---


@query
def vec_knn(s, d):
    return search.knn(vectors(s, d), ask(s, d, "vec_id = 0"), k=10)


@query
def vec_knn_restricted(s, d):
    return search.knn(vectors(s, d).where("label in (1, 2)"), ask(s, d, "vec_id = 0"), k=10)


@query
def vec_knn_batch(s, d):
    return search.knn(vectors(s, d), ask(s, d, "vec_id % 50 = 0"), k=5)


@query
def chunk_knn(s, d):
    """Every usable chunk vector against the stated queries, the chunks whose id is divisible by 50."""
    v = table(s, d, "chunk_vec").where(search.usable("embedding", 64)).select(F.col("chunk_id").alias("id"), F.col("embedding").alias("vec")).dropDuplicates(["id"])
    asked = v.where("id % 50 = 0").select(F.col("id").alias("q_idx"), F.col("vec").alias("qvec"))
    return search.knn(v, asked, k=5)


@query
def best_chunk_per_doc(s, d):
    return search.best_per_group(labelled_scores(s, d), "label")


@query
def chunk_pool_top3(s, d):
    return search.pooled(labelled_scores(s, d), "label")


@query
def cascade(s, d):
    v = vectors(s, d)
    heads = v.groupBy("label").agg(F.min("id").alias("id"))
    doc = first_scores(s, d).join(heads, "id").select(F.col("label").cast("bigint").alias("doc_id"), "score")
    chunk = labelled_scores(s, d).join(heads.select("id"), "id", "left_anti").select(F.col("id").alias("chunk_id"), F.col("label").cast("bigint").alias("doc_id"), "score")
    return search.cascade(doc, chunk)


@query
def hybrid_rrf(s, d):
    shared = table(s, d, "documents").select("doc_id").join(vectors(s, d).select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    keyword = search.bm25(idx(s, d), KEYWORDS, limit=40, restrict=shared)
    near = vectors(s, d).join(shared.select(F.col("doc_id").alias("id")), "id", "left_semi")
    vector = search.knn(near, ask(s, d, "vec_id = 0"), k=40).select(F.col("id").alias("doc_id"), "score", "rank")
    return search.rrf(keyword, vector)


@query
def hybrid_folded(s, d):
    copies = table(s, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    groups = copies.join(copies.groupBy("h").agg(F.min("doc_id").alias("work_id")), "h").select("doc_id", "work_id")
    return search.folded(search.bm25(idx(s, d), KEYWORDS, limit=60), groups, 20).select("doc_id", "work_id", "score", "rank")


@query
def snippet_best_chunk(s, d):
    return search.best_chunk_by_terms(table(s, d, "chunks"), "deliberation referendum legitimacy ballot")


@query
def snippet_window(s, d):
    return search.snippet_window(table(s, d, "documents").select("doc_id", "text"), "referendum ballot")


@query
def search_modes(s, d):
    """The same library asked in several ways: each mode with its results and the number of all matches."""
    shared = table(s, d, "documents").select("doc_id").join(vectors(s, d).select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    near = vectors(s, d).join(shared.select(F.col("doc_id").alias("id")), "id", "left_semi")
    vector = search.knn(near, ask(s, d, "vec_id = 0"), k=40).select(F.col("id").alias("doc_id"), "score", "rank")
    plain = lambda: search.bm25(idx(s, d), KEYWORDS, limit=40)
    bad = lambda: search.syntax_matches(search.fielded(table(s, d, "documents"), "doc_id", text=F.col("text")), "title:(glacier")
    count = lambda: search.matches(idx(s, d), KEYWORDS).count()
    asked = [retrieval.run(plain, count, vector), retrieval.run(plain, count, None), retrieval.run(plain, count, vector, keyword_only=True), retrieval.run(bad, count, vector)]
    parts = [o.results.select(F.lit(o.mode).alias("mode"), "doc_id", F.col("rank").cast("bigint").alias("rank"), F.lit(o.total).cast("bigint").alias("total")) for o in asked]
    return reduce(DataFrame.unionByName, parts)


@query
def fts_syntax(s, d):
    """A query of the index syntax over two columns."""
    rows = search.fielded(table(s, d, "documents").where("text is not null"), "doc_id", lang=F.col("lang"), text=F.col("text"))
    return search.syntax_matches(rows, "lang:en AND text:(glacier OR monsoon) NOT permafrost").select("doc_id")


@query
def fts_near(s, d):
    rows = search.fielded(table(s, d, "documents").where("text is not null"), "doc_id", text=F.col("text"))
    return search.syntax_matches(rows, "NEAR(debate records, 5)").select("doc_id")


def chunk_query(s, d):
    """A stated vector query: the usable chunk vector of the smallest id."""
    usable = table(s, d, "chunk_vec").where(search.usable("embedding", 64))
    first = usable.groupBy().agg(F.min_by("embedding", "chunk_id").alias("qvec"))
    return first.select(F.lit(0).cast("bigint").alias("q_idx"), "qvec")


@query
def hybrid_chunk_only(s, d):
    return retrieval.chunk_only(papers(s, d), table(s, d, "chunks"), table(s, d, "chunk_vec"), chunk_query(s, d), 64)


@query
def vector_leg(s, d):
    """Document vectors and chunk-only papers in one ranking."""
    p = papers(s, d)
    have = p.where("has_embeddings").select("id")
    near = search.knn(vectors(s, d).join(have, "id", "left_semi"), ask(s, d, "vec_id = 0"), k=40).select(F.col("id").alias("doc_id"), "score")
    return retrieval.vector_leg(near, hybrid_chunk_only(s, d), 40)


@query
def info_batch(s, d):
    asked = table(s, d, "chunks").select(F.col("doc_id").alias("id")).union(papers(s, d).select((F.col("id") * 2).alias("id")))
    found = retrieval.info(asked, papers(s, d), table(s, d, "paper_text"), table(s, d, "chunks"), "deliberation referendum legitimacy ballot")
    return found.select("id", "found", "display_title", "title_source", "head", "chunks", "top_chunk", "top_text")


@query
def search_with_snippets(s, d):
    """Papers found in the keyword index with the best snippet of each."""
    found = search.bm25(index_of(s, table(s, d, "paper_text"), "paper_id", "raw_text", f"{d}/paper_text"), KEYWORDS)
    near = retrieval.chunk_scores(table(s, d, "chunks"), table(s, d, "chunk_vec"), chunk_query(s, d), 64, 200)
    return retrieval.with_snippets(found, table(s, d, "chunks"), table(s, d, "paper_text"), KEYWORDS, near)


@query
def snippet_sources(s, d):
    found = papers(s, d).select(F.col("id").alias("doc_id"))
    return retrieval.snippet_sources(found, table(s, d, "chunks"), table(s, d, "paper_text"), "deliberation referendum legitimacy ballot").select("doc_id", "source")


@query
def read_full_text(s, d):
    got = retrieval.full_text(papers(s, d).select("id"), table(s, d, "paper_text"))
    return got.select("id", "format", F.length("text").cast("bigint").alias("n"))


@query
def read_owned_chunk(s, d):
    asked = table(s, d, "chunks").select("chunk_id", F.when(F.col("chunk_id") % 3 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id")).alias("doc_id"))
    return retrieval.owned_chunks(asked, table(s, d, "chunks")).select("chunk_id", "doc_id", F.coalesce("owned", F.lit(False)).alias("owned"), F.length("text").cast("bigint").alias("n"))


@query
def embedding_flags(s, d):
    return retrieval.embedded_flags(table(s, d, "chunks"), table(s, d, "chunk_vec").where(search.usable("embedding", 64)))


@query
def find_tiers(s, d):
    return find.find(papers(s, d), "referendum 2014", limit=50, ascii_only=True)


# --- quotes ---


def chunk_rows(s, d):
    return table(s, d, "chunks").where("text is not null").select("doc_id", "chunk_index", "text").distinct()


@query
def grep_exact(s, d):
    return grep.grep_exact(chunk_rows(s, d), NEEDLE)


@query
def grep_ignore_case(s, d):
    return grep.grep_exact(chunk_rows(s, d), NEEDLE.upper(), ignore_case=True)


@query
def grep_fallback(s, d):
    """Chunks, and the raw text of papers without chunks."""
    return grep.grep_exact(grep.searched(table(s, d, "chunks"), table(s, d, "paper_text")), NEEDLE)


@query
def grep_not_found(s, d):
    """Papers that hold the quote nowhere."""
    hits = grep_fallback(s, d)
    return grep.report(hits, 50, papers(s, d).select(F.col("id").alias("doc_id")))[2]


@query
def grep_normalized(s, d):
    rows = table(s, d, "paper_text").select(F.col("paper_id").alias("doc_id"), F.lit(0).alias("chunk_index"), F.col("raw_text").alias("text"))
    return grep.grep(rows, "rarely asked who records the")


@query
def grep_prefilter(s, d):
    return table(s, d, "documents").where(grep.can_match("debate over referendum records")).select("doc_id")


# --- queues and dashboards ---


@query
def queue_needs(s, d):
    return queue.queue(papers(s, d), needs=("ocr", "citekey"))


@query
def queue_has(s, d):
    return queue.queue(papers(s, d), has=("errors", "text"), exclude_encrypted=True)


@query
def queue_is(s, d):
    return queue.queue(papers(s, d), is_=("manual-metadata",), exclude_quarantined=True)


@query
def queue_miss(s, d):
    return queue.queue(papers(s, d), is_=("enrich-miss",))


@query
def queue_count(s, d):
    return queue.count(papers(s, d), needs=("ocr", "citekey"))


@query
def queue_suspicious(s, d):
    return queue.queue(queue.with_text_length(papers(s, d), table(s, d, "paper_text")), is_=("suspicious",))


@query
def queue_quarantined(s, d):
    return queue.queue(papers(s, d), is_=("broken",))


@query
def status_dashboard(s, d):
    return queue.status(papers(s, d))


@query
def pending_counts(s, d):
    return queue.pending(papers(s, d))


@query
def field_completeness(s, d):
    return queue.completeness(papers(s, d))


@query
def gap_ids(s, d):
    return queue.gaps(papers(s, d), "doi", attempted_only=True)


@query
def default_enrich(s, d):
    return queue.default_enrich(papers(s, d), retry_misses=True)


@query
def to_process(s, d):
    return queue.to_process(papers(s, d))


@query
def error_list(s, d):
    return queue.errors(papers(s, d))


@query
def retry_ids(s, d):
    return queue.retry(papers(s, d))


@query
def missing_ids(s, d):
    asked = table(s, d, "chunks").select(F.col("chunk_id").alias("pos"), (F.col("doc_id") + F.col("chunk_index") * 7).alias("id"))
    return queue.missing_ids(asked, papers(s, d))


@query
def resolve_identifiers(s, d):
    return queue.resolve(table(s, d, "bib").where("citekey is not null").select(F.upper("citekey").alias("ident")).distinct(), papers(s, d))


@query
def display_title(s, d):
    return queue.display(papers(s, d))


@query
def oneline(s, d):
    return sinks.as_lines(papers(s, d).select("id", "filename", "year", "citekey"), "id", "filename", "year", "citekey")


# --- works ---


@query
def works_hash(s, d):
    p = papers(s, d).where("file_hash is not null")
    return p.groupBy("file_hash").agg(F.min("id").alias("work_id"), F.count("*").alias("copies"))


@query
def works_members(s, d):
    return works.works(papers(s, d))


@query
def works_components(s, d):
    p = papers(s, d).select("id", "file_hash", F.lower("title").alias("t"), "year")
    first = lambda k: p.where(" and ".join(f"{c} is not null" for c in k)).select("id", F.min("id").over(works_window(k)).alias("b"))
    edges = first(["file_hash"]).union(first(["t", "year"])).select(F.col("id").alias("a"), "b")
    return components(edges)


def works_window(keys):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


@query
def works_canonical(s, d):
    p = papers(s, d).where("file_hash is not null")
    groups = p.select("id", F.min("id").over(works_window(["file_hash"])).alias("work_id"))
    return works.canonical(papers(s, d), groups)


# --- metadata and links ---


@query
def boilerplate_lines(s, d):
    return metadata.boilerplate(table(s, d, "paper_text"))


@query
def title_containment(s, d):
    text = table(s, d, "paper_text").select(F.col("paper_id").alias("id"), "raw_text")
    return papers(s, d).join(text, "id", "left").select("id", metadata.containment("title", "raw_text").alias("score"))


@query
def verify_metadata(s, d):
    return metadata.verify(papers(s, d), table(s, d, "paper_text"))


@query
def title_guesses(s, d):
    return frontmatter.title_guesses(table(s, d, "paper_text"))


@query
def contained_titles(s, d):
    """Papers with metadata whose stored title the text holds or lacks, by words alone."""
    text = table(s, d, "paper_text").select(F.col("paper_id").alias("id"), "raw_text")
    scored = papers(s, d).where(queue.is_enriched()).join(text, "id", "left").select("id", metadata.containment("title", "raw_text").alias("score"))
    return scored.withColumn("suspect", F.col("score") < metadata.CONTAINED)


@query
def meta_repairs(s, d):
    return repairs.repaired(papers(s, d))[1]


@query
def author_lists(s, d):
    return papers(s, d).select("id", F.to_json(repairs.author_list(F.col("authors"))).alias("names"))


@query
def file_name_parts(s, d):
    surname, year = repairs.file_name_parts(F.col("filename"))
    return papers(s, d).select("id", surname.alias("surname"), year.alias("year"))


@query
def cased_dois(s, d):
    return papers(s, d).where("doi is not null").select("id", repairs.cased_doi(F.col("doi")).alias("doi"))


@query
def audit_links(s, d):
    return metadata.audit(papers(s, d), table(s, d, "bib"), table(s, d, "paper_text"))


@query
def extract_doi(s, d):
    return table(s, d, "paper_text").select("paper_id", metadata.printed_doi_column("raw_text").alias("doi"))


@query
def enrich_from_bib(s, d):
    return metadata.enrich(papers(s, d), table(s, d, "bib").select("doi", "title", "authors", "year"), table(s, d, "paper_text"))


@query
def link_doi(s, d):
    return link.by_doi(papers(s, d), table(s, d, "bib"))


@query
def link_file(s, d):
    return link.by_file(papers(s, d), table(s, d, "bib"))


@query
def link_title_similarity(s, d):
    return link.by_title(papers(s, d), table(s, d, "bib"))


@query
def link_greedy_phases(s, d):
    return link.reconcile(papers(s, d), table(s, d, "bib"))


@query
def link_exact_phases(s, d):
    return link.reconcile(papers(s, d), table(s, d, "bib"), with_titles=False)


@query
def link_outcomes(s, d):
    return metadata.outcomes(link_exact_phases(s, d), "phase")


@query
def link_apply(s, d):
    return link.apply_matches(papers(s, d), link_exact_phases(s, d), table(s, d, "bib")).select("id", "citekey")


@query
def link_apply_suggested(s, d):
    """Suggested keys applied to every paper that has a suggestion, in the order of ids."""
    found = materialize(link_suggest(s, d), "suggestions")  # read several times, made once
    return link.apply_suggestions(papers(s, d), found, found.select(F.col("id").alias("pos"), "id"))[1]


@query
def bib_missing(s, d):
    return link.missing(table(s, d, "bib"), papers(s, d))


@query
def link_suggest(s, d):
    return link.suggest(papers(s, d), table(s, d, "bib"), table(s, d, "paper_text"))


@query
def link_pull(s, d):
    return link.pull(papers(s, d), table(s, d, "bib"), table(s, d, "paper_text")).select("id", "action", "changed", F.to_json("old").alias("old"), F.to_json("new").alias("new"))


@query
def link_pull_fields(s, d):
    """Only title, year and DOI are pulled."""
    return link.pull(papers(s, d).drop("authors"), table(s, d, "bib"), table(s, d, "paper_text")).select("id", "action", "changed")


@query
def citekey_base(s, d):
    p = papers(s, d)
    return p.select("id", link.citekey_base(F.regexp_extract("filename", r"^([A-Za-z]+)_", 1), F.col("year"), F.col("title")).alias("base"))


@query
def assign_citekeys(s, d):
    p = papers(s, d)
    wanted = p.where(~works.has_ink("citekey")).select("id", link.citekey_base(F.regexp_extract("filename", r"^([A-Za-z]+)_", 1), F.col("year"), F.col("title")).alias("base"))
    return link.assign_citekeys(wanted, p.where(works.has_ink("citekey")).select("citekey"))


@query
def bib_export(s, d):
    return link.bib_entries(papers(s, d), "pdf/")


# --- chunks and pages ---


@query
def chunk_documents(s, d):
    return chunking.chunk_documents(table(s, d, "paper_text"))


@query
def section_headers(s, d):
    return chunking.section_heads(table(s, d, "paper_text"))


@query
def embedding_text(s, d):
    p = papers(s, d).select(F.col("id").alias("doc_id"), "title")
    return table(s, d, "chunks").join(p, "doc_id", "left").select("chunk_id", chunking.embedding_text().alias("embedded")).distinct()


@query
def page_map(s, d):
    pages = table(s, d, "paper_text").where("raw_text is not null").select(F.col("paper_id").alias("doc_id"), F.posexplode(F.split("raw_text", "\f")).alias("page_no", "text"))
    return chunking.assign_pages(pages, table(s, d, "chunks"))


@query
def chunk_context(s, d):
    asked = table(s, d, "chunks").where("chunk_index = 3").select("doc_id", "chunk_index").distinct()
    return chunking.context(table(s, d, "chunks"), asked)


@query
def page_fill(s, d):
    return chunking.fill_pages(table(s, d, "chunks"))


@query
def read_range(s, d):
    return chunking.chunks_between(table(s, d, "chunks"), 2, 4)


@query
def read_range_missing(s, d):
    return chunking.missing_between(table(s, d, "chunks"), papers(s, d).select(F.col("id").alias("doc_id")), 2, 4)


# --- ledgers ---


def as_reviews(s, d):
    """Opens as reviews: the verdict by the seconds spent."""
    verdict = F.when(F.col("seconds").isNull(), "later").when(F.col("seconds") > 600, "key").when(F.col("seconds") > 200, "good").when(F.col("seconds") > 60, "later").otherwise("doubt")
    return table(s, d, "opens").where("path is not null").select(F.col("path").alias("item"), F.col("open_id").alias("seq"), F.col("opened_at").alias("at"), verdict.alias("verdict")).distinct()


@query
def inbox_next_interval(s, d):
    o = table(s, d, "opens").select("open_id", F.coalesce(F.col("seconds") / 60.0, F.lit(0.0)).alias("prev"), F.element_at(F.array(*(F.lit(v) for v in ledger.VERDICTS)), (F.col("open_id") % 5 + 1).cast("int")).alias("verdict"), (F.col("open_id") % 3).alias("reviews")).distinct()
    return o.select("open_id", F.round(ledger.next_interval(F.col("prev"), F.col("verdict"), F.col("reviews")), 6).alias("days"))


@query
def inbox_replay(s, d):
    return ledger.replay(as_reviews(s, d))


@query
def inbox_due(s, d):
    return ledger.by_status(ledger.replay(as_reviews(s, d)), "due", F.lit("2026-01-01").cast("timestamp_ntz"))


@query
def opens_state(s, d):
    return ledger.opens_state(table(s, d, "opens").distinct())


@query
def ledger_fold(s, d):
    o = table(s, d, "opens").where("file_hash is not null").distinct()
    return ledger.fold(o, ["file_hash"], "open_id").select("file_hash", F.col("open_id").alias("last_open"), "opened_by")


@query
def identity_match(s, d):
    return identity.match(table(s, d, "opens").where("file_hash is not null and path is not null"), papers(s, d))


def collection_events(s, d):
    """Opens as events of collections: one for each reader; what was opened without a page, or every third time, was removed."""
    o = table(s, d, "opens").where("file_hash is not null and path is not null").distinct()
    gone = F.col("page").isNull() | (F.col("open_id") % 3 == 0)
    return o.select(
        F.lit("member").alias("kind"), F.when(gone, "remove").otherwise("add").alias("op"), F.col("open_id").alias("batch"), F.concat(F.lit("b"), F.col("open_id") % 10).alias("batch_id"),
        F.col("opened_by").alias("collection_id"), F.xxhash64("opened_by", "file_hash", "path").alias("member_id"), "file_hash", "path",
        *(F.lit(None).cast("string").alias(c) for c in ("filename", "title", "citekey", "why")), F.col("opened_by").alias("by"), F.col("opened_at").alias("at"),
    )


@query
def collection_members(s, d):
    return collections.members_now(collection_events(s, d)).where("live").select("collection_id", "file_hash", "path", "batch_id")


@query
def collection_resolved(s, d):
    """Live members of each collection: how many, and how many are a paper, ambiguous or missing now."""
    now = collections.resolved(collections.members_now(collection_events(s, d)).where("live"), papers(s, d))
    counts = [F.count_if(F.col("status") == x).alias(x) for x in ("found", "ambiguous", "missing")]
    return now.groupBy("collection_id").agg(F.count("*").alias("count"), *counts)


@query
def collection_undo(s, d):
    """What undoing the additions of batch b4 would reverse, and what not."""
    events = collection_events(s, d)
    mine, skipped = collections.undo_members(events, "b4", "add")
    states = collections.members_now(events)
    done = states.join(mine, "member_id", "left_semi").select("collection_id", "file_hash", "path", F.lit("reversed").alias("outcome"))
    left = states.join(mine, "member_id", "left_anti").join(events.where("batch_id = 'b4' and op = 'add'").select("member_id"), "member_id", "left_semi")
    return done.unionByName(left.select("collection_id", "file_hash", "path", F.lit("already_removed").alias("outcome")))


@query
def collection_drift(s, d):
    """Live members whose paper has another hash or path now, with the new keys; a key that a member has is left."""
    now = collections.resolved(collections.members_now(collection_events(s, d)).where("live"), papers(s, d))
    moved, _ = collections.drifted_keys(now, papers(s, d), ["collection_id"])
    return moved.select("collection_id", "file_hash", "path").distinct()


def inbox_items(s, d):
    """Opens as inbox items: a passage where a page is known, due when opened, every seventh done."""
    o = table(s, d, "opens").where("file_hash is not null and path is not null").distinct()
    done = F.col("open_id") % 7 == 0
    return o.select(
        F.col("open_id").alias("item_id"), "file_hash", "path", F.when(F.col("open_id") % 2 == 0, F.col("page")).alias("page"), F.col("opened_at").alias("due_at"),
        (F.coalesce("seconds", F.lit(0.0)) / 60).alias("interval_days"), F.lit("good").alias("last_verdict"), F.when(done, F.col("logged_at")).alias("retired_at"),
    )


@query
def ledger_state_for(s, d):
    now = F.lit("2026-01-01").cast("timestamp_ntz")
    state = inbox.state_for(inbox_items(s, d), table(s, d, "opens").where("file_hash is not null and path is not null").distinct(), papers(s, d), now)
    return state.withColumn("interval_days", F.round("interval_days", 6))


@query
def inbox_status(s, d):
    now = F.lit("2026-01-01").cast("timestamp_ntz")
    return inbox_items(s, d).groupBy(inbox.status_at(now).alias("status")).agg(F.count("*").alias("items"))


@query
def collection_intersection(s, d):
    """Papers asked for by the log, in the order of their first opening, that have a citekey."""
    o = table(s, d, "opens").where("path is not null").groupBy("path").agg(F.min("open_id").alias("pos"))
    asked = papers(s, d).join(o, "path").select("pos", "id")
    return sinks.in_order(asked, papers(s, d).where(works.has_ink("citekey")).select("id"))


# --- files, notes, catalog ---


@query
def prune_papers(s, d):
    seen = table(s, d, "opens").where("path is not null").select("path").distinct()
    kept, texts = library.prune(papers(s, d), seen, (table(s, d, "paper_text"), "paper_id"))
    return texts.select("paper_id")


@query
def vault_refs(s, d):
    notes = table(s, d, "bib").where("abstract is not null").select(F.col("entry_id").cast("string").alias("note"), F.col("abstract").alias("text"))
    return library.references(notes)


@query
def schema_tables(s, d):
    return library.describe({n: table(s, d, n) for n in ("papers", "paper_text", "bib", "chunks", "chunk_vec", "opens")})


def listed_files(s, d):
    """A listing of files as a scan would give it: most papers as they are, some touched, changed, gone or new."""
    p = papers(s, d).where("path is not null")
    kept = p.where("id % 11 <> 0").select(
        "path", F.col("file_size").alias("length"), F.when(F.col("id") % 5 == 0, F.col("file_modified") + F.expr("interval 1 hour")).otherwise(F.col("file_modified")).alias("modified"),
        F.when(F.col("id") % 10 == 0, F.concat("file_hash", F.lit("x"))).otherwise(F.col("file_hash")).alias("hash"),
    )
    new = p.where("id % 13 = 0").select(F.concat("path", F.lit(".new.pdf")).alias("path"), F.lit(1).cast("bigint").alias("length"), "file_modified", F.concat(F.lit("new"), "id").alias("hash"))
    return kept.union(new)


@query
def ingest_files(s, d):
    p = papers(s, d).dropDuplicates(["path"])
    out, _ = process.ingest(p.withColumn("id", F.col("id")), listed_files(s, d).dropDuplicates(["path"]), now=F.lit("2026-01-01").cast("timestamp_ntz"))
    return out.select("id", "path", "filename", "file_hash", "file_size", "has_text", "has_embeddings")


@query
def process_outcomes(s, d):
    """Texts put into an empty library; papers whose text is null fail."""
    p = papers(s, d)
    got = p.join(table(s, d, "paper_text").select(F.col("paper_id").alias("id"), "raw_text", "markdown"), "id")
    error = F.when(F.col("raw_text").isNull(), F.lit("no text"))
    empty = process.Library(p, table(s, d, "paper_text").limit(0), table(s, d, "chunks").limit(0), table(s, d, "chunk_vec").limit(0))
    done = process.process(empty, got.select("id", "raw_text", F.coalesce("markdown", F.lit("")).alias("markdown"), error.alias("error")))
    return done.papers.select("id", "has_text", "has_chunk_embeddings", "error_count")


@query
def page_backfill(s, d):
    pages = table(s, d, "paper_text").where("raw_text is not null").select(F.col("paper_id").alias("doc_id"), F.posexplode(F.split("raw_text", "\f")).alias("page_no", "text"))
    return process.page_backfill(table(s, d, "chunks"), pages, papers(s, d))[1]


@query
def stream_opens_hourly(s, d):
    return hourly(table(s, d, "opens").distinct()).select(F.col("hour").cast("timestamp_ntz").alias("hour"), "opens")


def core_queries() -> dict[str, Query]:
    return dict(QUERIES)


def core_oracles() -> dict[str, str]:
    return dict(ORACLES)


