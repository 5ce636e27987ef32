"""Works: the copies of one paper in a library, and the copy that stands for them.

Two rows are the same work if they share the file hash; the normalized DOI while titles
agree; or normalized title and year for titles of five words or more. DOI and title count
only where both page counts are known and differ by at most two, neither row is suspect,
and titles printed on both don't contradict.

Rows that are alike in everything an edge looks at form one class, linked as a star, and
only class representatives meet in pairs, inside equal keys and near page counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from paperlake.functions import titles
from paperlake.functions.titles import normal_doi
from paperlake.operators.components import components
from paperlake.plans.lineage import materialize

MAX_PAGE_DIFFERENCE = 2
_FORMS = T.StructType([T.StructField("ascii", T.StringType()), T.StructField("plain", T.StringType()), T.StructField("heading", T.BooleanType())])


@pandas_udf(_FORMS)
def title_forms(column: pd.Series) -> pd.DataFrame:
    """ASCII and plain form of a title and whether it can name a work by itself."""
    ascii_forms = column.map(titles.ascii_title)
    heading = [len(t.split()) >= titles.LEAST_TITLE_WORDS and not titles.is_generic(t) for t in ascii_forms]
    return pd.DataFrame({"ascii": ascii_forms, "plain": column.map(titles.plain_title), "heading": heading})


@pandas_udf(T.BooleanType())
def _agree(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b, plain_a, plain_b in batches:
        yield pd.Series([titles.agree(*x) for x in zip(a, b, plain_a, plain_b)], dtype=bool)


def has_ink(column: str | Column) -> Column:
    """Neither null nor blank."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).rlike(r"\S"), F.lit(False))


def display_title(title: str = "title", layout: str = "title_from_layout", filename: str = "filename") -> Column:
    return F.when(has_ink(title), F.col(title)).when(has_ink(layout), F.col(layout)).otherwise(F.coalesce(F.col(filename), F.lit("")))


def _edges(rows: DataFrame, key: list[str], titles_too: bool) -> DataFrame:
    """Edges (a, b) among rows of equal ``key`` whose pages are near and whose titles agree."""
    alike = [*key, "pages", "disp", "disp_plain", "lay", "lay_plain", "printed"]
    if not titles_too:
        alike = [c for c in alike if not c.startswith("disp")]
    self_ok = (~F.col("printed")) | (F.col("lay") != "")
    if titles_too:
        self_ok = self_ok & (F.col("disp") != "")
    rep = rows.groupBy(*alike).agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    rep = materialize(rep, "works-classes")
    inside = rows.join(rep.where("n > 1").where(self_ok), alike).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    several = rep.groupBy(*key).agg(F.count("*").alias("classes")).where("classes > 1").select(*key)
    rep = rep.join(several, key, "left_semi")
    left = rep.select(*key, *(F.col(c).alias(f"x_{c}") for c in rep.columns if c not in (*key, "n")))
    left = left.withColumn("pages", F.explode(F.sequence(F.col("x_pages") - MAX_PAGE_DIFFERENCE, F.col("x_pages") + MAX_PAGE_DIFFERENCE)))
    pairs = left.join(rep, [*key, "pages"]).where("x_rep < rep")
    if titles_too:
        pairs = pairs.where(F.col("x_disp") == F.col("disp")).unionByName(
            pairs.where(F.col("x_disp") != F.col("disp")).where(_agree("x_disp", "disp", "x_disp_plain", "disp_plain"))
        )
    printed = F.col("x_printed") & F.col("printed")
    free = pairs.where(~printed | (F.col("x_lay") == F.col("lay")) & (F.col("lay") != ""))
    judged = pairs.where(printed & (F.col("x_lay") != F.col("lay"))).where(_agree("x_lay", "lay", "x_lay_plain", "lay_plain"))
    return inside.union(free.unionByName(judged).select(F.col("x_rep").alias("a"), F.col("rep").alias("b")))


def work_edges(papers: DataFrame) -> DataFrame:
    """Edges (a, b) between rows of ``papers`` that are copies of one work."""
    rows = papers.where("id is not null").select(
        F.col("id").cast("bigint").alias("id"), "file_hash", F.when(has_ink("doi"), normal_doi(F.col("doi"))).alias("ndoi"), "year",
        F.col("page_count").cast("int").alias("pages"), F.coalesce("metadata_suspect", F.lit(False)).alias("suspect"),
        F.coalesce(F.col("title"), F.lit("")).alias("title"), display_title().alias("display"),
        F.coalesce(F.col("title_from_layout"), F.lit("")).alias("layout"),
    )
    hashed = rows.where("file_hash is not null and file_hash <> ''").select("id", "file_hash")
    first = hashed.groupBy("file_hash").agg(F.min("id").alias("b"), F.count("*").alias("n")).where("n > 1")
    same = hashed.join(first, "file_hash").where("id <> b").select(F.col("id").alias("a"), "b")
    gated = rows.where("not suspect and pages is not null").withColumns(
        {"t": title_forms("title"), "d": title_forms("display"), "l": title_forms("layout"), "printed": has_ink("layout")}
    )
    gated = gated.select(
        "id", "ndoi", "year", "pages", "printed", F.col("t.ascii").alias("name"), F.col("t.heading").alias("heading"), F.col("d.ascii").alias("disp"),
        F.col("d.plain").alias("disp_plain"), F.col("l.ascii").alias("lay"), F.col("l.plain").alias("lay_plain"),
    )
    gated = materialize(gated, "works-rows")
    by_doi = _edges(gated.where("ndoi is not null"), ["ndoi"], titles_too=True)
    by_name = _edges(gated.where("heading and year is not null"), ["name", "year"], titles_too=False)
    return same.union(by_doi).union(by_name)


def works(papers: DataFrame) -> DataFrame:
    """(id, work_id) of every row of ``papers``; work_id is the smallest id of the work."""
    found = components(work_edges(papers))
    ids = papers.where("id is not null").select(F.col("id").cast("bigint").alias("id")).distinct()
    return ids.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("work_id"))


def source_rank(source: Column) -> Column:
    """0 entered by hand, 1 from a bibliography, 2 from the first provider, 3 anything else."""
    s = F.lower(F.coalesce(source, F.lit("")))
    return F.when(s.startswith("bib:"), 1).when(s.contains("manual"), 0).when(s.startswith("openalex"), 2).otherwise(3)


def canonical_order() -> list[Column]:
    """Ascending keys of the order in which copies may stand for their work."""
    newest = F.coalesce(F.unix_micros(F.col("indexed_at").cast("timestamp")), F.lit(-(2**62)))
    return [
        (~has_ink("citekey")).cast("int"), source_rank(F.col("metadata_source")), F.coalesce("metadata_suspect", F.lit(False)).cast("int"),
        (~F.coalesce("has_text", F.lit(False))).cast("int"), -newest, F.col("id").cast("bigint"),
    ]


def canonical(papers: DataFrame, membership: DataFrame) -> DataFrame:
    """(work_id, canonical_id, copies) of every work."""
    order = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(canonical_order())))
    ranked = papers.select("id", order.alias("k")).join(membership, "id")
    return ranked.groupBy("work_id").agg(F.min("k").getField("k5").alias("canonical_id"), F.countDistinct("id").alias("copies"))
