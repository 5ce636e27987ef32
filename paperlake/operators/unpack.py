"""Several values packed in one field: one row per value, with its position.

The field's ordinary characters are masked into a delimiter skeleton, a splitting rule
(token spans of the values) is resolved once per distinct skeleton, and the rules are
joined back and applied by position. Rows far outnumber skeletons, so rule resolution is
paid per shape; rows with their skeletons are written once. The rules are broadcast only
below a checked number of bytes; beyond it they are joined by a shuffle whose hot skeletons
are salted.

Defined results: null, empty, blank and "[]" fields give no row; empty places, "et al."
and "others" take no position; repeated rows give repeated values; other columns of the
input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from paperlake.functions import packed
from paperlake.plans.lineage import materialize

MAX_BROADCAST_BYTES = 64_000_000  # of rules with their skeletons
SALTS = 32

_RULE = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("esc", T.BooleanType())]))


@pandas_udf(T.StringType())
def skeleton_of(texts: pd.Series) -> pd.Series:
    return texts.map(packed.skeleton)


@pandas_udf(_RULE)
def rule_of(skeletons: pd.Series) -> pd.Series:
    return skeletons.map(lambda sk: [{"a": a, "b": b, "esc": e} for a, b, e in packed.resolve(sk)])


@pandas_udf(T.ArrayType(T.StringType()))
def values_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, rules in batches:
        yield pd.Series([packed.extract(t, [(r["a"], r["b"], r["esc"]) for r in rule]) for t, rule in zip(texts, rules)])


def unpack(df: DataFrame, record_id: str, column: str, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """(record_id BIGINT, pos INT from 1, name STRING) of every value packed in ``column``."""
    rows = (
        df.select(F.col(f"`{record_id}`").cast("bigint").alias("record_id"), F.col(f"`{column}`").cast("string").alias("packed"))
        .where(F.col("packed").isNotNull() & (F.trim("packed") != ""))
        .withColumn("shape", skeleton_of("packed"))
    )
    rows = materialize(rows, "unpack-rows")
    rules = materialize(rows.select("shape").distinct().select("shape", rule_of("shape").alias("rule")), "unpack-rules")
    size = rules.agg(F.sum(F.length("shape") + 24 * F.size("rule") + 40).alias("bytes")).first()["bytes"] or 0
    if size <= max_broadcast_bytes:
        joined = rows.join(F.broadcast(rules), "shape")
    else:
        salted = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.hash("record_id"), F.lit(SALTS))).join(salted, ["shape", "salt"])
    return joined.select("record_id", F.posexplode(values_of("packed", "rule")).alias("at", "name")).select(
        "record_id", (F.col("at") + 1).cast("int").alias("pos"), "name"
    )
