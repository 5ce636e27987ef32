"""Files against the catalog: ingest differences, pruning, vault references."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

REFERENCE = r"\[\[([^\]\|#]+\.pdf)(?:[#|][^\]]*)?\]\]|\]\(([^)\s]+\.pdf)\)|(?m)^source:\s*(\S+\.pdf)\s*$"


def diff(files: DataFrame, papers: DataFrame) -> DataFrame:
    """(path, change): new, changed, touched, unchanged or missing, by path, size, time, then hash."""
    f = files.select("path", F.col("length").alias("f_size"), F.col("modified").alias("f_time"), F.col("hash").alias("f_hash"))
    p = papers.select("path", F.col("file_size").alias("p_size"), F.col("file_modified").alias("p_time"), F.col("file_hash").alias("p_hash"))
    fast = (F.col("f_size") == F.col("p_size")) & (F.col("f_time") == F.col("p_time"))
    change = F.when(F.col("p_hash").isNull(), "new").when(F.col("f_hash").isNull(), "missing").when(fast, "unchanged").when(F.col("f_hash") == F.col("p_hash"), "touched").otherwise("changed")
    return f.join(p, "path", "full_outer").select("path", change.alias("change"))


def prune(papers: DataFrame, files: DataFrame, *dependents: tuple[DataFrame, str]) -> tuple[DataFrame, ...]:
    """Papers whose file exists, and dependent tables (with their paper column) without the rest's rows.

    An empty listing is refused: the folder itself is more likely gone than every file.
    """
    if files.limit(1).count() == 0:
        raise ValueError("no file listed; not pruning the whole library")
    gone = papers.join(files, "path", "left_anti").select("id")
    return (papers.join(gone, "id", "left_anti"), *(d.join(gone, d[c] == gone["id"], "left_anti") for d, c in dependents))


def references(notes: DataFrame) -> DataFrame:
    """(note, ref): base names of PDFs that notes (note, text) link, embed or give as source."""
    link = F.regexp_extract_all("text", F.lit(r"\[\[([^\]|#]+\.pdf)"), F.lit(1))
    markdown = F.regexp_extract_all("text", F.lit(r"\]\(([^)\s]+\.pdf)\)"), F.lit(1))
    source = F.regexp_extract_all("text", F.lit(r"(?m)^source:\s*(\S+\.pdf)\s*$"), F.lit(1))
    refs = F.explode(F.array_distinct(F.concat(link, markdown, source)))
    return notes.select("note", refs.alias("ref")).select("note", F.element_at(F.split("ref", "/"), -1).alias("ref")).distinct()


def orphans(notes: DataFrame, papers: DataFrame) -> DataFrame:
    """(note, ref) whose file no paper has."""
    return references(notes).join(papers.select(F.col("filename").alias("ref")), "ref", "left_anti").select("note", "ref")


def uncovered(notes: DataFrame, papers: DataFrame) -> DataFrame:
    """(id, filename) of papers that no note refers to."""
    refs = references(notes).select(F.col("ref").alias("filename"))
    return papers.select("id", "filename").join(refs, "filename", "left_anti")


def describe(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, type) of every column."""
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame([(n, f.name, f.dataType.simpleString()) for n, t in tables.items() for f in t.schema.fields], "table_name string, column_name string, type string")
