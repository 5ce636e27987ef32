"""Stored (file_hash, path) keys against papers: both, then hash, then path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def match(keys: DataFrame, papers: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """(file_hash, path, paper_id, status): found, ambiguous or missing for every distinct key.

    live (path) names files that exist; a live candidate of any tier beats a dead one.
    """
    k = keys.select("file_hash", "path").distinct()
    p = papers.select("id", F.col("file_hash").alias("p_hash"), F.col("path").alias("p_path"))
    hashed = k.join(p, F.col("file_hash") == F.col("p_hash"))
    tiers = [
        hashed.where(F.col("path") == F.col("p_path")).withColumn("tier", F.lit(0)),
        hashed.where(~F.coalesce(F.col("path") == F.col("p_path"), F.lit(False))).withColumn("tier", F.lit(1)),
        k.join(p, F.col("path") == F.col("p_path")).where(~F.coalesce(F.col("file_hash") == F.col("p_hash"), F.lit(False))).withColumn("tier", F.lit(2)),
    ]
    found = reduce(DataFrame.unionByName, tiers)
    if live is not None:
        alive = live.select(F.col("path").alias("p_path"), F.lit(0).alias("dead")).distinct()
        found = found.join(alive, "p_path", "left").withColumn("tier", F.col("tier") + 10 * F.coalesce("dead", F.lit(1)))
    best = found.groupBy("file_hash", "path").agg(F.min(F.struct("tier", "id")).alias("b"), F.min("tier").alias("t"))
    ties = found.groupBy("file_hash", "path", "tier").agg(F.countDistinct("id").alias("n"))
    joined = best.alias("b1").join(
        ties.alias("t1"), F.col("b1.file_hash").eqNullSafe(F.col("t1.file_hash")) & F.col("b1.path").eqNullSafe(F.col("t1.path")) & (F.col("b1.t") == F.col("t1.tier"))
    ).select("b1.file_hash", "b1.path", F.col("b1.b.id").alias("id"), "t1.n")
    out = k.alias("k").join(joined.alias("j"), F.col("k.file_hash").eqNullSafe(F.col("j.file_hash")) & F.col("k.path").eqNullSafe(F.col("j.path")), "left")
    status = F.when(F.col("j.n").isNull(), "missing").when(F.col("j.n") > 1, "ambiguous").otherwise("found")
    return out.select("k.file_hash", "k.path", F.when(F.col("j.n") == 1, F.col("j.id")).alias("paper_id"), status.alias("status"))


def attach(rows: DataFrame, found: DataFrame, how: str = "left") -> DataFrame:
    """Rows (file_hash, path, …) with what ``match`` found for their keys."""
    named = found.withColumnsRenamed({"file_hash": "_hash", "path": "_path"})
    return rows.join(named, F.col("file_hash").eqNullSafe(F.col("_hash")) & F.col("path").eqNullSafe(F.col("_path")), how).drop("_hash", "_path")
