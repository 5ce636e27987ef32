"""The reading inbox: papers or passages to read, rescheduled by verdicts, kept as events.

An item's schedule is what its latest schedule event says: adding makes it due at once, a
review reschedules it and an undone review puts the schedule before it back. Items follow
moved and copied files like members of collections.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

from paperlake.operators.collections import KEPT, KEYS, UndoConflict, drifted_keys, materialized
from paperlake.operators.events import Ledger, latest
from paperlake.operators.identity import attach, match
from paperlake.operators.ledger import VERDICTS, InvalidArgument, LedgerError, by_status, next_interval, require_by
from paperlake.operators.works import display_title

SOURCES = ("manual", "agent", "vault")  # fixed values
SCHEDULE = ("due_at", "interval_days", "reviews", "last_verdict", "last_reviewed_at", "retired_at")
SCHEMA = (
    "kind string, op string, batch bigint, batch_id string, item_id bigint, file_hash string, path string, filename string, title string, "
    "citekey string, page int, quote string, note string, source string, verdict string, due_at timestamp_ntz, interval_days double, "
    "reviews int, last_verdict string, last_reviewed_at timestamp_ntz, retired_at timestamp_ntz, by string, why string, at timestamp_ntz, "
    "undoes string, n bigint"
)
OPENS = "file_hash string, path string, page int, seconds double, opened_by string, opened_at timestamp_ntz, logged_at timestamp_ntz"


class UnknownItem(LedgerError):
    code = "unknown_item"


class ItemRetired(LedgerError):
    code = "item_retired"


class UnknownPaper(LedgerError):
    code = "unknown_paper"


def clean_passage(passage: dict | None) -> dict:
    """page (from 1), quote and note of a passage; all None for a whole paper."""
    if passage is None:
        return {"page": None, "quote": None, "note": None}
    page = passage.get("page")
    if type(page) is not int or page < 1:
        raise InvalidArgument("a passage needs a page, counted from 1")
    for name in ("quote", "note"):
        if not isinstance(passage.get(name), str | None):
            raise InvalidArgument(f"a passage's {name} must be text")
    return {"page": page, "quote": passage.get("quote") or None, "note": passage.get("note") or None}


def items_now(events: DataFrame) -> DataFrame:
    """Every item ever made with its keys, passage, schedule and whether it is live (not removed)."""
    added = F.struct("page", "quote", "note", "source", F.col("by").alias("added_by"), "why", F.col("at").alias("added_at"), "batch_id")
    of = events.where("kind = 'item'").groupBy("item_id").agg(
        latest(F.struct(*KEYS, *KEPT), ("add", "rekey")).alias("k"), latest(added, ("add",)).alias("a"),
        latest(F.struct(*SCHEDULE), ("add", "review", "unreview")).alias("s"), F.coalesce(latest(F.col("op"), ("add", "remove")) != "remove", F.lit(True)).alias("live"),
    )
    return of.select("item_id", "k.*", "a.*", "s.*", "live")


def status_at(now: Column) -> Column:
    return F.when(F.col("retired_at").isNotNull(), "done").when(F.col("due_at") <= now, "due").otherwise("scheduled")


def best_items(items: DataFrame) -> DataFrame:
    """The item that speaks for each paper_id, with its number of active passages.

    Active before retired; then the whole paper before passages, then the soonest due; of
    retired ones the latest.
    """
    retired = F.col("retired_at").isNotNull()
    late = F.coalesce(F.unix_micros(F.coalesce("retired_at", "due_at").cast("timestamp")), F.lit(0))
    order = F.struct(retired.cast("int"), F.when(retired, -late).otherwise(F.col("page").isNotNull().cast("bigint")), F.when(retired, -F.col("item_id")).otherwise(late), F.when(retired, F.lit(0)).otherwise(F.col("item_id")))
    best = F.min_by(F.struct("item_id", "due_at", "interval_days", "last_verdict", "retired_at"), order).alias("b")
    return items.groupBy("paper_id").agg(best, F.count_if(F.col("page").isNotNull() & ~retired).alias("passages")).select("paper_id", "b.*", "passages")


def state_for(items: DataFrame, opens: DataFrame, papers: DataFrame, now: Column, ids: DataFrame | None = None, live: DataFrame | None = None) -> DataFrame:
    """(paper_id, item_id, status, due_at, interval_days, last_verdict, passages, opens, last_opened).

    items are live items with their keys; opens the log. Every paper that has an item or was opened.
    """
    counted = opens.groupBy(*KEYS).agg(F.count("*").alias("opens"), F.max("opened_at").alias("last_opened"))
    keys = items.select(*KEYS).union(counted.select(*KEYS)).distinct()
    found = match(keys, papers, live).where("paper_id is not null").select(*KEYS, "paper_id")
    if ids is not None:
        found = found.join(ids.select(F.col("id").alias("paper_id")).distinct(), "paper_id", "left_semi")
    best = best_items(attach(items, found, "inner"))
    read = attach(counted, found, "inner").groupBy("paper_id").agg(F.sum("opens").alias("opens"), F.max("last_opened").alias("last_opened"))
    both = best.join(read, "paper_id", "full_outer")
    status = F.when(F.col("item_id").isNotNull(), status_at(now)).alias("status")
    return both.select("paper_id", "item_id", status, "due_at", "interval_days", "last_verdict", F.coalesce("passages", F.lit(0)).alias("passages"), F.coalesce("opens", F.lit(0)).alias("opens"), "last_opened")


class Inbox(Ledger):
    table, schema = "inbox_events", SCHEMA

    def opens(self) -> DataFrame:
        return self.catalog.read("opens_log") if self.catalog.has("opens_log") else self.spark.createDataFrame([], OPENS)

    def _live(self) -> DataFrame:
        return items_now(self.events()).where("live")

    # --- writing

    def enqueue(self, ids: DataFrame, papers: DataFrame, by: str, why: str | None = None, source: str = "manual", passage: dict | None = None, live: DataFrame | None = None) -> tuple[str, DataFrame]:
        """(batch, (id, item_id, outcome added, already_present or not_found)); due now, once a live item or passage."""
        by = require_by(by)
        if source not in SOURCES:
            raise InvalidArgument(f"unknown source {source}")
        place = {k: F.lit(v).cast("int" if k == "page" else "string") for k, v in clean_passage(passage).items()}
        active = self._live().where("retired_at is null")
        for k, v in place.items():
            active = active.where(F.col(k).eqNullSafe(v)) if passage is not None or k == "page" else active
        found = match(active.select(*KEYS), papers, live)
        now = attach(active, found.select(*KEYS, "paper_id"))
        held = now.where("paper_id is not null").groupBy(F.col("paper_id").alias("id")).agg(F.min("item_id").alias("held"))
        keyed = now.groupBy(*KEYS).agg(F.min("item_id").alias("keyed"))
        title = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("title_from_layout"))
        asked = papers.join(ids.select("id").distinct(), "id", "left_semi").select("id", *KEYS, "filename", title.alias("title"), "citekey")
        told = asked.join(held, "id", "left").join(keyed, list(KEYS), "left")
        batch_id = uuid.uuid4().hex[:12]
        told = told.withColumn("item_id", F.coalesce("held", "keyed", F.xxhash64(F.lit(batch_id), *KEYS))).withColumn("outcome", F.when(F.coalesce("held", "keyed").isNull(), "added").otherwise("already_present"))
        told = materialized(told)
        fresh = told.where("outcome = 'added'").dropDuplicates(list(KEYS))
        made = self.rows(fresh, kind=F.lit("item"), op=F.lit("add"), **place, source=F.lit(source), by=F.lit(by), why=F.lit(why), at=self.now, due_at=self.now, reviews=F.lit(0))
        report = ids.select("id").distinct().join(told.select("id", "item_id", "outcome"), "id", "left").select("id", "item_id", F.coalesce("outcome", F.lit("not_found")).alias("outcome"))
        report = materialized(report)
        return self.commit("enqueue", by, [made], batch_id=batch_id, why=why), report

    def review(self, item_id: int, verdict: str, by: str) -> str:
        """The batch; the item is due again after ``next_interval`` days, or retired by "done"."""
        by = require_by(by)
        if verdict not in VERDICTS:
            raise InvalidArgument(f"unknown verdict {verdict}")
        item = self._live().where(F.col("item_id") == item_id)
        row = item.first()
        if row is None:
            raise UnknownItem(str(item_id))
        if row["retired_at"] is not None:
            raise ItemRetired(str(item_id))
        days = next_interval(F.col("interval_days"), F.lit(verdict), F.col("reviews"))
        new = item.withColumn("days", days).withColumn("at", self.now)
        rows = self.rows(
            new.drop("interval_days", "due_at", "reviews", "retired_at"), kind=F.lit("item"), op=F.lit("review"), by=F.lit(by), verdict=F.lit(verdict), interval_days=F.col("days"),
            due_at=F.expr("at + make_dt_interval(0, 0, 0, days * 86400)"), reviews=F.lit(row["reviews"] + 1), last_verdict=F.lit(verdict), last_reviewed_at=F.col("at"),
            retired_at=F.when(F.col("days").isNull(), F.col("at")),
        )
        return self.commit("review", by, [rows], item_id=item_id, verdict=verdict)

    def record_open(self, paper_id: int, papers: DataFrame, by: str, page: int | None = None, seconds: float | None = None) -> None:
        """Append to the log of opened files; the log is never undone."""
        by = require_by(by)
        if page is not None and (type(page) is not int or page < 1) or seconds is not None and seconds < 0:
            raise InvalidArgument("page counts from 1, seconds from 0")
        row = papers.where(F.col("id") == paper_id).select(*KEYS, F.lit(page).cast("int").alias("page"), F.lit(seconds).cast("double").alias("seconds"), F.lit(by).alias("opened_by"), self.now.alias("opened_at"), self.now.alias("logged_at"))
        if row.first() is None:
            raise UnknownPaper(str(paper_id))
        self.catalog.append(opens_log=row)

    # --- reading

    def items(self, papers: DataFrame, status: str = "active", live: DataFrame | None = None) -> DataFrame:
        """Items of a status (active, due, scheduled, done, all) with the paper they are now."""
        items = by_status(self._live().withColumn("item", F.col("item_id")).withColumn("due_at", F.when(F.col("retired_at").isNull(), F.col("due_at"))), status, self.now).drop("item")
        found = match(items.select(*KEYS), papers, live)
        shown = papers.select(F.col("id").alias("paper_id"), display_title().alias("display_title"))
        out = attach(items, found.withColumnRenamed("status", "resolution"))
        return out.withColumn("status", status_at(self.now)).join(shown, "paper_id", "left").drop("live").orderBy(*(["due_at"] if status in ("due", "scheduled") else []), "added_at", "item_id")

    def due(self, papers: DataFrame, limit: int | None = None, live: DataFrame | None = None) -> DataFrame:
        out = self.items(papers, "due", live)
        return out if limit is None else out.limit(limit)

    def state_for(self, ids: DataFrame, papers: DataFrame, live: DataFrame | None = None) -> DataFrame:
        return state_for(self._live(), self.opens(), papers, self.now, ids, live)

    # --- undoing

    def undo(self, batch_id: str, by: str) -> tuple[str, DataFrame]:
        """(batch, (item_id, reason) of what could no longer be reversed)."""
        by, head = require_by(by), self.undone(batch_id)
        events = self.events()
        own = events.where("kind = 'item'").where(F.col("batch_id") == batch_id)
        if head["op"] == "enqueue":
            mine = items_now(events).join(own.select("item_id"), "item_id", "left_semi")
            rows = self.rows(mine.where("live").select("item_id"), kind=F.lit("item"), op=F.lit("remove"), by=F.lit(by), at=self.now)
            skipped = materialized(mine.where("not live").select("item_id", F.lit("already_removed").alias("reason")))
            return self.commit("undo", by, [rows], undoes=batch_id), skipped
        if head["op"] != "review":
            raise LedgerError(f"a {head['op']} batch cannot be undone")
        item_id = head["item_id"]
        item = items_now(events).where(F.col("item_id") == item_id).first()
        if not item["live"]:
            raise UndoConflict(f"item {item_id} was removed since; undo that first")
        schedules = events.where("kind = 'item'").where(F.col("item_id") == item_id).where(F.col("op").isin("add", "review", "unreview"))
        undone = self.batches().where("undoes is not null").select(F.col("undoes").alias("batch_id"))
        standing = schedules.where("op <> 'unreview'").join(undone, "batch_id", "left_anti").orderBy(F.desc("batch"))
        latest_two = standing.select("batch_id", *SCHEDULE).limit(2).collect()
        if latest_two[0]["batch_id"] != batch_id:
            raise UndoConflict(f"item {item_id} was reviewed again since; undo that first")
        if item["retired_at"] is not None and item["page"] is None:
            again = items_now(events).where("live and retired_at is null and page is null").where((F.col("item_id") != item_id) & F.col("file_hash").eqNullSafe(item["file_hash"]) & F.col("path").eqNullSafe(item["path"]))
            if again.first() is not None:
                raise UndoConflict("the paper was enqueued again since; undo that first")
        before = self.spark.createDataFrame([tuple(latest_two[1][c] for c in SCHEDULE)], ", ".join(f for f in SCHEMA.split(", ") if f.split()[0] in SCHEDULE))
        rows = self.rows(before, kind=F.lit("item"), op=F.lit("unreview"), item_id=F.lit(item_id), by=F.lit(by), at=self.now)
        return self.commit("undo", by, [rows], undoes=batch_id, item_id=item_id), self.spark.createDataFrame([], "item_id bigint, reason string")

    def refresh(self, papers: DataFrame, live: DataFrame | None = None) -> dict[str, int]:
        """Keys of moved items brought up to date, retired ones' too; counts of what was seen."""
        items = self._live()
        found = match(items.select(*KEYS), papers, live)
        now = attach(items, found)
        # only active whole-paper items can be in each other's way
        scope = F.when(F.col("page").isNull() & F.col("retired_at").isNull(), F.lit(0)).otherwise(F.col("item_id"))
        moved, report = drifted_keys(materialized(now.withColumn("place", scope)), papers, ["place"])
        if report["updated"]:
            rows = self.rows(moved.select("item_id", *KEYS, *KEPT), kind=F.lit("item"), op=F.lit("rekey"), by=F.lit("refresh"), at=self.now)
            report["batch_id"] = self.commit("refresh", "refresh", [rows], report["updated"])
        return report
