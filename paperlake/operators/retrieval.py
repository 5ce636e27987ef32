"""What a user's search does: choice of mode, chunk-only papers, snippets, and information on papers.

Every function takes and gives DataFrames; a query's vector is a one-row DataFrame (q_idx, qvec).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from paperlake.functions.query import QuerySyntaxError
from paperlake.operators import search
from paperlake.operators.queue import display

HEAD = 300  # characters of a paper's text that are shown


@dataclass(frozen=True)
class Outcome:
    """Ranked results of one query. mode: hybrid, vector_fallback, fts, fts_only, cascade or doc; total: all matches."""

    mode: str
    results: DataFrame
    total: int
    error: str | None = None


def chunk_scores(chunks: DataFrame, chunk_vec: DataFrame, query: DataFrame, dim: int, k: int | None = None) -> DataFrame:
    """(chunk_id, doc_id, score): cosine of the usable chunk vectors with the query, the best k or all."""
    usable = chunk_vec.where(search.usable("embedding", dim)).select(F.col("chunk_id").alias("id"), F.col("embedding").alias("vec")).dropDuplicates(["id"])
    scored = search.scores(usable, query, k)
    owners = chunks.where("doc_id is not null").groupBy("chunk_id").agg(F.min("doc_id").alias("doc_id"))
    met = scored.join(owners, scored.id == owners.chunk_id).select("chunk_id", "doc_id", "score")
    return met if k is None else met.orderBy(F.desc("score"), "chunk_id").limit(k)


def chunk_only(papers: DataFrame, chunks: DataFrame, chunk_vec: DataFrame, query: DataFrame, dim: int, limit: int = 20, k: int | None = None, restrict: DataFrame | None = None) -> DataFrame:
    """(doc_id, score): papers with chunk vectors but no document vector, by their best chunk.

    Without a restriction only the best ``k`` chunks of the library count, max(10 limit, 200) by default.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    only = papers.where(~flag("has_embeddings") & flag("has_chunk_embeddings")).select(F.col("id").alias("doc_id"))
    if restrict is not None:
        near = chunk_scores(chunks.join(restrict.select("doc_id").distinct(), "doc_id", "left_semi"), chunk_vec, query, dim)
    else:
        near = chunk_scores(chunks, chunk_vec, query, dim, k or max(10 * limit, 200))
    best = near.join(only, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), "doc_id").limit(limit)


def vector_leg(documents: DataFrame, chunk_only_papers: DataFrame, limit: int) -> DataFrame:
    """(doc_id, score, rank) of document vectors and chunk-only papers together; of equal scores documents first."""
    both = documents.select("doc_id", "score", F.lit(0).alias("leg")).unionByName(chunk_only_papers.select("doc_id", "score", F.lit(1).alias("leg")))
    once = both.groupBy("doc_id").agg(F.min(F.struct(-F.col("score"), "leg")).alias("m")).select("doc_id", (-F.col("m.col1")).alias("score"), "m.leg")
    top = once.orderBy(F.desc("score"), "leg", "doc_id").limit(limit)
    return top.select("doc_id", "score", F.row_number().over(Window.orderBy(F.desc("score"), "leg", "doc_id")).cast("bigint").alias("rank"))


def run(keyword, total, vector: DataFrame | None, limit: int = 20, keyword_only: bool = False, restricted: bool = False) -> Outcome:
    """The mode that can answer. keyword() gives ranked results of 2 limit and may raise QuerySyntaxError; total() counts matches."""
    try:
        found = keyword()
    except QuerySyntaxError as e:
        if vector is None or keyword_only:
            raise
        results = vector.select("doc_id", "score", "rank").where(F.col("rank") <= limit)
        return Outcome("vector_fallback", results, results.count(), str(e))
    if vector is None or keyword_only:
        results = found.where(F.col("rank") <= limit)
        return Outcome("fts_only" if keyword_only else "fts", results, results.count() if restricted else total())
    fused = search.rrf(found, vector, limit)
    by = Window.orderBy(F.desc("score"), F.coalesce("rank_fts", F.lit(2**31)), F.coalesce("rank_vector", F.lit(2**31)), "doc_id")
    results = fused.withColumn("rank", F.row_number().over(by).cast("bigint"))
    return Outcome("hybrid", results, results.count() if restricted else total())


def semantic(documents: DataFrame, chunk_scored: DataFrame | None, limit: int = 10, documents_only: bool = False) -> Outcome:
    """Coarse-to-fine search over chunks where there are any, else over document vectors (doc_id, score)."""
    if documents_only or chunk_scored is None or chunk_scored.first() is None:
        results = documents.orderBy(F.desc("score"), "doc_id").limit(limit)
        return Outcome("doc", results, results.count())
    results = search.cascade(documents, chunk_scored, limit)
    return Outcome("cascade", results, results.count())


def snippet_sources(results: DataFrame, chunks: DataFrame, paper_text: DataFrame, query: str, near: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, text): what each result's snippet is cut from.

    The chunk nearest to the query's vector (near: chunk_id, doc_id, score); else the chunk with
    most distinct query stems; else the text around the first stem, or its start.
    """
    docs = results.select("doc_id").distinct()
    own = chunks.join(docs, "doc_id", "left_semi")
    by_terms = search.best_chunk_by_terms(own, query).join(own.select("doc_id", "chunk_index", "text").dropDuplicates(["doc_id", "chunk_index"]), ["doc_id", "chunk_index"]).select("doc_id", F.col("text").alias("by_terms"))
    raw = paper_text.select(F.col("paper_id").alias("doc_id"), F.col("raw_text").alias("text")).join(docs, "doc_id", "left_semi")
    window = search.snippet_window(raw, query).select("doc_id", F.col("window").alias("by_text"))
    out = docs.join(by_terms, "doc_id", "left").join(window, "doc_id", "left")
    if near is None:
        out = out.withColumn("by_vector", F.lit(None).cast("string"))
    else:
        best = search.best_per_group(near.join(docs, "doc_id", "left_semi"), "doc_id", "chunk_id").select("chunk_id")
        text = own.join(best, "chunk_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("by_vector"))
        out = out.join(text, "doc_id", "left")
    source = F.when(F.col("by_vector").isNotNull(), "vector_chunk").when(F.col("by_terms").isNotNull(), "term_chunk").when(F.col("by_text").isNotNull(), "text")
    return out.select("doc_id", source.alias("source"), F.coalesce("by_vector", "by_terms", "by_text").alias("text"))


def with_snippets(results: DataFrame, chunks: DataFrame, paper_text: DataFrame, query: str, near: DataFrame | None = None) -> DataFrame:
    """Results (doc_id, …) with the snippet cut from the best source."""
    return search.snippets(results, snippet_sources(results, chunks, paper_text, query, near), query)


def info(ids: DataFrame, papers: DataFrame, paper_text: DataFrame, chunks: DataFrame, query: str | None = None) -> DataFrame:
    """One row for each asked id (id): found, titles, the head of its text, its chunks and, for a query, its top chunk.

    chunks counts distinct indices; top_chunk is the chunk with most query stems, its text beside it.
    """
    asked = ids.select("id").distinct()
    p = papers.join(asked, "id", "left_semi")
    about = p.select("id", "filename", "authors", "year", "doi", "citekey", F.lit(True).alias("found")).join(display(p), "id")
    head = paper_text.select(F.col("paper_id").alias("id"), F.substring("raw_text", 1, HEAD).alias("head"))
    own = chunks.select(F.col("doc_id").alias("id"), "chunk_index", "text").join(asked, "id", "left_semi")
    counts = own.groupBy("id").agg(F.countDistinct("chunk_index").alias("chunks"))
    out = asked.join(about, "id", "left").join(head, "id", "left").join(counts, "id", "left")
    out = out.withColumn("found", F.coalesce("found", F.lit(False))).withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    if query is None:
        return out
    best = search.best_chunk_by_terms(own.withColumnRenamed("id", "doc_id"), query).select(F.col("doc_id").alias("id"), F.col("chunk_index").alias("top_chunk"))
    texts = own.select("id", F.col("chunk_index").alias("top_chunk"), F.col("text").alias("top_text")).dropDuplicates(["id", "top_chunk"])
    return out.join(best.join(texts, ["id", "top_chunk"], "left"), "id", "left")


def full_text(ids: DataFrame, paper_text: DataFrame) -> DataFrame:
    """(id, text, format): a paper's markdown if it has any, else its raw text."""
    text = paper_text.select(F.col("paper_id").alias("id"), "markdown", "raw_text")
    marked = F.col("markdown").isNotNull() & (F.col("markdown") != "")
    return ids.select("id").distinct().join(text, "id", "left").select("id", F.when(marked, F.col("markdown")).otherwise(F.col("raw_text")).alias("text"), F.when(marked, "markdown").when(F.col("raw_text").isNotNull(), "raw").alias("format"))


def owned_chunks(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, owned, text) of asked (chunk_id, doc_id): whether the chunk is the paper's, its text only then."""
    own = chunks.select("chunk_id", F.col("doc_id").alias("owner"), "text").dropDuplicates(["chunk_id"])
    same: Column = F.col("owner").eqNullSafe(F.col("doc_id"))
    return asked.select("chunk_id", "doc_id").distinct().join(own, "chunk_id", "left").select("chunk_id", "doc_id", same.alias("owned"), F.when(same, F.col("text")).alias("text"))


def embedded_flags(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(doc_id, complete): whether every chunk of a paper has a usable vector (chunk_id)."""
    have = vectors.select("chunk_id", F.lit(True).alias("have")).distinct()
    return chunks.select("doc_id", "chunk_id").distinct().join(have, "chunk_id", "left").groupBy("doc_id").agg((F.count_if(F.col("have").isNull()) == 0).alias("complete"))


def embed_chunks(papers: DataFrame, chunks: DataFrame, embed=search.hash_embedding) -> DataFrame:
    """(chunk_id, embedding) from title, section and text; embed is a column function of the text."""
    from paperlake.operators.chunking import embedding_text

    titled = chunks.join(papers.select(F.col("id").alias("doc_id"), "title"), "doc_id", "left")
    return titled.select("chunk_id", embed(embedding_text()).alias("embedding")).dropDuplicates(["chunk_id"])


def embed_documents(papers: DataFrame, paper_text: DataFrame, embed=search.hash_embedding, most: int = 30_000, prefix: str = "search_document: ") -> DataFrame:
    """(id, embedding) from title, abstract and the first ``most`` characters of the text."""
    text = paper_text.select(F.col("paper_id").alias("id"), "raw_text").where("raw_text is not null and raw_text <> ''")
    extra = [c for c in ("abstract",) if c in papers.columns]
    whole = F.substring(F.concat_ws("\n\n", F.when(F.col("title") != "", F.col("title")), *extra, "raw_text"), 1, most)
    return papers.join(text, "id").select("id", embed(F.concat(F.lit(prefix), whole)).alias("embedding"))
