"""The best representative of each duplicate group, by skyline selection.

Records of a group are compared by completeness (citekey, text), trust (source, not
suspect) and recency. A record is dominated if another is at least as good in all five and
better in one. The undominated records are the first layer, those dominated only by them
the second, and so on. Inside the first layer a lexicographic policy picks the survivor;
its null fields are filled from the other records, layer by layer, in the policy's order.
Bibliographic fields of suspect records are used only where no other record has them.

Records of a group that agree in all but recency and have the same fields filled are
represented by the newest before anything is gathered, so a group of any size reaches a
task as at most 32 times two to the number of fields records.

Defined results: equal records are ordered by smaller id; blank strings count as null;
repeated rows of one id count once; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from paperlake.operators.works import canonical_order, has_ink, works
from paperlake.plans.lineage import materialize

FIELDS = ("citekey", "metadata_source", "title", "authors", "year", "doi", "page_count", "title_from_layout")
BIBLIOGRAPHIC = frozenset(("title", "authors", "year", "doi"))
_SURVIVOR = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("layer_one", T.IntegerType()), T.StructField("values", T.ArrayType(T.StringType())), T.StructField("sources", T.ArrayType(T.LongType()))]
)


def layers(points: list[tuple[int, ...]]) -> list[int]:
    """Dominance layer of each point, from 1; smaller is better in every place.

    A point's layer is one more than the largest of its dominators, which all come before it
    in lexicographic order; equal points are looked at once.
    """
    layer: dict[tuple[int, ...], int] = {}
    for p in sorted(set(points)):
        layer[p] = 1 + max((n for q, n in layer.items() if all(a <= b for a, b in zip(q, p))), default=0)
    return [layer[p] for p in points]


@pandas_udf(_SURVIVOR)
def _survive(groups: pd.Series) -> pd.DataFrame:
    out = []
    for records in groups:
        points = [(r["k0"], r["k1"], r["k2"], r["k3"], r["k4"]) for r in records]
        layer = layers(points)
        order = sorted(range(len(records)), key=lambda i: (layer[i], points[i], records[i]["id"]))
        best = records[order[0]]
        values, sources = [], []
        for n, field in enumerate(FIELDS):
            line = sorted(order, key=lambda i: points[i][2]) if field in BIBLIOGRAPHIC else order
            line = [order[0], *(i for i in line if i != order[0])] if not (field in BIBLIOGRAPHIC and points[order[0]][2]) else line
            giver = next((i for i in line if records[i]["values"][n] is not None), None)
            values.append(None if giver is None else records[giver]["values"][n])
            sources.append(None if giver is None else records[giver]["id"])
        out.append((best["id"], sum(x == 1 for x in layer), values, sources))
    return pd.DataFrame(out, columns=["id", "layer_one", "values", "sources"])


def survivors(papers: DataFrame, membership: DataFrame) -> DataFrame:
    """One record per work: work_id, canonical_id, copies, undominated, the fields and where each is from."""
    keys = canonical_order()
    filled = [F.when(has_ink(F.col(f).cast("string")), F.col(f).cast("string")) for f in FIELDS]
    rows = papers.where("id is not null").select(
        F.col("id").cast("bigint").alias("id"), *(k.alias(f"k{i}") for i, k in enumerate(keys[:5])), F.array(*filled).alias("values")
    )
    rows = rows.join(membership, "id")
    mask = F.transform("values", lambda v: v.isNull())
    record = F.struct("id", "k0", "k1", "k2", "k3", "k4", "values")
    kept = rows.groupBy("work_id", "k0", "k1", "k2", "k3", mask.alias("mask")).agg(F.min_by(record, F.struct("k4", "id")).alias("record"))
    copies = membership.groupBy("work_id").agg(F.count("*").alias("copies")).where("copies > 1")
    kept = kept.join(copies, "work_id")
    grouped = kept.groupBy("work_id").agg(F.max("copies").alias("copies"), F.collect_list("record").alias("records"))
    done = grouped.withColumn("s", _survive("records"))
    fields = [F.col("s.values")[i].alias(f) for i, f in enumerate(FIELDS)]
    return done.select("work_id", F.col("s.id").alias("canonical_id"), "copies", F.col("s.layer_one").alias("undominated"), *fields, F.col("s.sources").alias("sources"))


def surviving_works(papers: DataFrame) -> DataFrame:
    """The surviving record of every work with two or more rows in ``papers``."""
    return survivors(papers, materialize(works(papers), "works"))
