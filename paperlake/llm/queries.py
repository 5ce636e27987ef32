"""The driver-facing queries of the llm operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperlake.llm.bpe import encode
from paperlake.llm.knn import nearest
from paperlake.llm.leaks import leaks
from paperlake.llm.linkage import link_works
from paperlake.llm.markup import fields, found_kinds, residue
from paperlake.llm.ocr import repaired
from paperlake.llm.splitting import split_chunks, split_items
from paperlake.llm.subjects import subjects_of
from paperlake.llm.survivors import surviving_works
from paperlake.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of chunks of cosine 0.88 or more, one among the ten most similar of the other."""
    near = nearest(table(spark, root, "chunk_vec"), "chunk_id", "embedding", dim=64, k=10, min_similarity=0.88, recall=0.99)
    a, b = F.col("id"), F.col("neighbour_id")
    return near.where(a != b).select(F.least(a, b).alias("chunk_id_a"), F.greatest(a, b).alias("chunk_id_b")).distinct()


def _markup_fields(spark: SparkSession, root: str) -> DataFrame:
    bib, text = table(spark, root, "bib"), table(spark, root, "paper_text")
    parts = [
        fields(bib, "entry_id", "title", "bib.title", True, "bib_source"),
        fields(bib, "entry_id", "abstract", "bib.abstract", True, "bib_source"),
        fields(text, "paper_id", "markdown", "paper_text.markdown", False),
    ]
    return reduce(DataFrame.unionByName, parts)


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """The kinds of markup residue in bib.title, bib.abstract and paper_text.markdown."""
    return found_kinds(_markup_fields(spark, root))


def p2_clean(spark: SparkSession, root: str) -> DataFrame:
    """The clean text of the three fields."""
    return residue(_markup_fields(spark, root)).select("field", "record_id", "clean")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Papers rows and bib entries about the same work."""
    return p3_links(spark, root).select("paper_id", "entry_id")


def p3_links(spark: SparkSession, root: str) -> DataFrame:
    """The same pairs with their confidence."""
    return link_works(table(spark, root, "papers"), table(spark, root, "bib"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Lines of paper_text.raw_text that are noisy, and how."""
    got = repaired(table(spark, root, "paper_text"), with_text=False, papers=table(spark, root, "papers"))
    return got.select(F.col("id").alias("paper_id"), F.explode("cases").alias("c")).select("paper_id", "c.line_no", "c.kind").distinct()


def p4_paragraphs(spark: SparkSession, root: str) -> DataFrame:
    """The texts repaired into continuous paragraphs; null and empty ones stay so."""
    texts = table(spark, root, "paper_text")
    empty = texts.where("raw_text is null or raw_text = ''").select(F.col("paper_id").cast("bigint"), F.col("raw_text").cast("string").alias("text"))
    return repaired(texts, papers=table(spark, root, "papers")).select(F.col("id").alias("paper_id"), "text").unionAll(empty)


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Cuts that can't be avoided: two neighbouring blocks that together exceed 1,800 characters."""
    pieces = split_items(table(spark, root, "chunks"), once=False)
    return pieces.where("cut_kind = 'forced'").select(F.col("id").alias("chunk_id"), "cut_offset").distinct()


def p5_pieces(spark: SparkSession, root: str) -> DataFrame:
    """The pieces of every oversized chunk, with right offsets in the paper's markdown."""
    return split_chunks(table(spark, root, "chunks"), table(spark, root, "paper_text"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Every work with several rows in papers and the row that stands for it."""
    return surviving_works(table(spark, root, "papers")).select("work_id", "canonical_id")


def p7_records(spark: SparkSession, root: str) -> DataFrame:
    """The surviving record of every such work, field by field."""
    return surviving_works(table(spark, root, "papers"))


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    """The ids of every document's text by byte_bpe_50k; null and empty texts have none."""
    return encode(table(spark, root, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents that hold 12 or more consecutive words of a held-out item, with the item."""
    return leaks(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    """The one or two subject areas that each document is about."""
    got = subjects_of(table(spark, root, "documents"), table(spark, root, "subject_labels"), table(spark, root, "subjects"))
    return got.select("doc_id", "subject")


def llm_queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_clean, p3_found, p3_links, p4_found, p4_paragraphs, p5_found, p5_pieces, p7_found, p7_records, p8_ids, p9_found, p10_found)}


def llm_oracles() -> dict[str, str]:
    return {}
