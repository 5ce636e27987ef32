"""Sinks: JSON lines, tab-separated lines, id lists, BibTeX."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def cell(c: str | Column) -> Column:
    """One line without tabs."""
    return F.coalesce(F.trim(F.regexp_replace((F.col(c) if isinstance(c, str) else c).cast("string"), r"\s+", " ")), F.lit(""))


def as_lines(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.concat_ws("\t", *(cell(c) for c in columns or df.columns)).alias("value"))


def select_fields(df: DataFrame, fields: list[str]) -> tuple[DataFrame, list[str]]:
    """The known fields in the order given, and the unknown names."""
    known = [f for f in fields if f in df.columns]
    return df.select(*known), [f for f in fields if f not in df.columns]


def first_seen(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Distinct ids over all queries in first-seen order, from (q_idx, rank, id)."""
    return df.groupBy(id_col).agg(F.min(F.struct("q_idx", "rank")).alias("at")).orderBy("at").select(id_col)


def in_order(asked: DataFrame, members: DataFrame) -> DataFrame:
    """(pos, id) of asked ids that are members, each once, in the order asked."""
    return asked.join(members.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("pos").alias("pos")).select("pos", "id").orderBy("pos", "id")


def write_text(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "errorifexists").text(path)
