"""Running numbers without gathering rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paperlake.plans.lineage import materialize


def numbered(df: DataFrame, order: list[str], name: str = "n", start: int = 1) -> DataFrame:
    """df with numbers from ``start`` in the order of the given columns.

    Rows are sorted by range; only the row count of each partition goes to the driver.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed.withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND((1 << 33) - 1)}).drop("_at"), "numbered")
    offset, pairs = start, []
    for part, rows in sorted(tuple(r) for r in placed.groupBy("_part").count().collect()):
        pairs.append((part, offset))
        offset += rows
    starts = df.sparkSession.createDataFrame(pairs or [(0, start)], "_part bigint, _start bigint")
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_row")).drop("_part", "_row", "_start")
