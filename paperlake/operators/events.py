"""Append-only event ledgers in a catalog: every write is a batch, and undoing one is another.

The state is a fold of the events, never stored: for each entity the latest event of a kind,
found by aggregates that combine before the shuffle, so an entity of any number of events is
no hot key. Batches are numbered by the single writer; rows of one batch need no order.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from paperlake.operators.ledger import AlreadyUndone, UnknownBatch, require_by
from paperlake.plans.catalog import Catalog
from paperlake.plans.lineage import materialize


def latest(value: Column, ops: tuple[str, ...]) -> Column:
    """The value of the latest event of these ops."""
    return F.max_by(F.when(F.col("op").isin(*ops), value), F.when(F.col("op").isin(*ops), F.col("batch")))


class Ledger:
    """Events of one table of a catalog. ``now`` may be given, for tests and replays."""

    table = "events"
    schema = ""

    def __init__(self, catalog: Catalog, now: Column | None = None):
        self.catalog, self.spark = catalog, catalog.spark
        self.now = F.current_timestamp().cast("timestamp_ntz") if now is None else now

    def events(self) -> DataFrame:
        """All events, in no order; a ledger that was never written has none and isn't created by reading."""
        return self.catalog.read(self.table) if self.catalog.has(self.table) else self.spark.createDataFrame([], self.schema)

    def batches(self) -> DataFrame:
        return self.events().where("kind = 'batch'")

    def rows(self, df: DataFrame, **values: Column) -> DataFrame:
        """Event rows from a DataFrame; columns neither in it nor given are null."""
        names = [f.split()[0] for f in self.schema.split(", ")]
        kinds = dict(f.split() for f in self.schema.split(", "))
        have = {**{c: F.col(c) for c in df.columns}, **values}
        return df.select(*(have.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in names))

    def commit(self, op: str, by: str, parts: list[DataFrame], counted: int | None = None, **about) -> str:
        """Append the parts as one batch with its head row; its id."""
        batch_id = about.pop("batch_id", None) or uuid.uuid4().hex[:12]
        number = (self.events().agg(F.max("batch")).first()[0] or 0) + 1
        head = self.spark.range(1).select(F.lit("batch").alias("kind"), F.lit(op).alias("op"), F.lit(by).alias("by"), self.now.alias("at"), *(F.lit(v).alias(k) for k, v in about.items()))
        body = reduce(DataFrame.unionByName, parts) if parts else None
        if body is not None:
            body = materialize(body, "events")
            counted = body.count() if counted is None else counted
        head = self.rows(head, n=F.lit(counted or 0))
        whole = head if body is None else head.unionByName(body)
        self.catalog.append(**{self.table: whole.withColumn("batch", F.lit(number).cast("bigint")).withColumn("batch_id", F.lit(batch_id))})
        return batch_id

    def undone(self, batch_id: str):
        """The head of a batch that may be undone."""
        head = self.batches().where(F.col("batch_id") == batch_id).first()
        if head is None:
            raise UnknownBatch(batch_id)
        if self.batches().where(F.col("undoes") == batch_id).first() is not None:
            raise AlreadyUndone(batch_id)
        return head

    def history(self, limit: int = 50, where: Column | None = None) -> DataFrame:
        """One row a batch, newest first, with what undid it."""
        heads = self.batches() if where is None else self.batches().where(where)
        by = self.batches().where("undoes is not null").select(F.col("undoes").alias("batch_id"), F.col("batch_id").alias("undone_by"))
        return heads.join(by, "batch_id", "left").orderBy(F.desc("batch")).limit(limit)


__all__ = ["Ledger", "latest", "require_by"]
