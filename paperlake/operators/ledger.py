"""Event ledgers: collections and the reading inbox as append-only events folded to a state.

An event is (seq, batch_id, op, entity, key…, by, at); removing appends, undoing appends the
opposite. Current state is the last event of each key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

VERDICTS = ("key", "good", "later", "doubt", "done")
FIRST, KEY_TIMES, KEY_LEAST, GOOD_TIMES, LATER_TIMES, DOUBT_TIMES, DOUBT_LEAST, DOUBT_MOST = 1.0, 3.0, 7.0, 2.0, 1.5, 0.5, 1.0, 2.0


class LedgerError(Exception):
    code = "ledger"


class NameConflict(LedgerError):
    code = "name_conflict"


class UnknownBatch(LedgerError):
    code = "unknown_batch"


class AlreadyUndone(LedgerError):
    code = "already_undone"


class InvalidArgument(LedgerError):
    code = "invalid_argument"


def require_by(by: str) -> str:
    if not by or not by.strip():
        raise InvalidArgument("every write names who makes it")
    return by.strip()


def fold(events: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last event of each key."""
    order = Window.partitionBy(*keys).orderBy(F.desc(seq))
    return events.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def next_interval(previous: Column, verdict: Column, reviews: Column) -> Column:
    """Days until an item is due again; null retires it."""
    first = (F.coalesce(reviews, F.lit(0)) == 0) | (F.coalesce(previous, F.lit(0.0)) == 0)
    prev = F.when(first, F.lit(FIRST)).otherwise(previous.cast("double"))
    return (
        F.when(verdict == "done", F.lit(None).cast("double"))
        .when(verdict == "key", F.greatest(prev * KEY_TIMES, F.lit(KEY_LEAST)))
        .when(first, F.lit(FIRST))
        .when(verdict == "good", prev * GOOD_TIMES)
        .when(verdict == "later", prev * LATER_TIMES)
        .otherwise(F.least(F.greatest(prev * DOUBT_TIMES, F.lit(DOUBT_LEAST)), F.lit(DOUBT_MOST)))
    )


def replay(reviews: DataFrame, item: str = "item", verdict: str = "verdict", at: str = "at", seq: str = "seq") -> DataFrame:
    """(item, reviews, interval_days, due_at, last_at) after the whole history of each item.

    One item's verdicts are gathered in order; a review is a person's act, so an item has few.
    """
    history = reviews.groupBy(item).agg(F.sort_array(F.collect_list(F.struct(at, seq, verdict))).alias("h"))
    start = F.struct(F.lit(0.0).alias("days"), F.lit(0).alias("n"), F.lit(False).alias("gone"))

    def step(s: Column, e: Column) -> Column:
        days = next_interval(s["days"], e[verdict], s["n"])
        return F.struct(F.coalesce(days, F.lit(0.0)).alias("days"), (s["n"] + 1).alias("n"), days.isNull().alias("gone"))

    end = history.select(item, F.aggregate("h", start, step).alias("s"), F.element_at("h", -1)[at].alias("last_at"))
    due = F.when(~F.col("s.gone"), F.expr("last_at + make_dt_interval(0, 0, 0, s.days * 86400)"))
    return end.select(item, F.col("s.n").alias("reviews"), F.when(~F.col("s.gone"), F.col("s.days")).alias("interval_days"), due.alias("due_at"), "last_at")


def by_status(items: DataFrame, status: str, now: Column) -> DataFrame:
    """active, due, scheduled, done or all items (due_at null: retired), in their order."""
    active = F.col("due_at").isNotNull()
    picked = {"active": active, "due": active & (F.col("due_at") <= now), "scheduled": active & (F.col("due_at") > now), "done": ~active, "all": F.lit(True)}
    if status not in picked:
        raise InvalidArgument(f"unknown status {status}")
    return items.where(picked[status]).orderBy(*(["due_at", "item"] if status in ("due", "scheduled", "active") else ["item"]))


def members(events: DataFrame) -> DataFrame:
    """(collection, paper_id) live now, from events (seq, op add/remove, collection, paper_id)."""
    return fold(events, ["collection", "paper_id"]).where("op = 'add'").select("collection", "paper_id")


def add(events: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """Events with the memberships of ``new`` that are not live yet appended; adding twice changes nothing."""
    by = require_by(by)
    last = events.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("top"), F.coalesce(F.max("batch_id"), F.lit(0)).alias("batch"))
    fresh = new.distinct().join(members(events), ["collection", "paper_id"], "left_anti").crossJoin(F.broadcast(last))
    order = Window.orderBy("collection", "paper_id")
    rows = fresh.select((F.col("top") + F.row_number().over(order)).alias("seq"), (F.col("batch") + 1).alias("batch_id"), F.lit("add").alias("op"), "collection", "paper_id", F.lit(by).alias("by"))
    return events.select(*rows.columns).unionByName(rows)


def undo(events: DataFrame, batch_id: int, by: str) -> DataFrame:
    """Events with the opposite of a batch appended, where its events are still the last of their keys."""
    by = require_by(by)
    batch = events.where(F.col("batch_id") == batch_id)
    if batch.limit(1).count() == 0:
        raise UnknownBatch(str(batch_id))
    last = events.agg(F.max("seq").alias("top"), F.max("batch_id").alias("batch"))
    still = fold(events, ["collection", "paper_id"]).where(F.col("batch_id") == batch_id)
    if still.limit(1).count() == 0:
        raise AlreadyUndone(str(batch_id))
    rows = still.crossJoin(F.broadcast(last)).select(
        (F.col("top") + F.row_number().over(Window.orderBy("seq"))).alias("seq"), (F.col("batch") + 1).alias("batch_id"),
        F.when(F.col("op") == "add", "remove").otherwise("add").alias("op"), "collection", "paper_id", F.lit(by).alias("by"),
    )
    return events.select(*rows.columns).unionByName(rows)


def opens_state(opens: DataFrame) -> DataFrame:
    """(file_hash, path, opens, last_at): how often and when last each file was opened."""
    return opens.groupBy("file_hash", "path").agg(F.count("*").alias("opens"), F.max("opened_at").alias("last_at"))
