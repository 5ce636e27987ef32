"""Collections of papers: named sets kept as events, whose members follow moved and copied files.

A member is known by the (file hash, path) that it had; which row of papers it is now is
decided at reading time (see ``identity``), with ambiguous and missing members told apart.
"""

from __future__ import annotations

import unicodedata
import uuid

from pyspark.sql import DataFrame, functions as F

from paperlake.operators.events import Ledger, latest
from paperlake.operators.identity import attach, match
from paperlake.operators.ledger import InvalidArgument, LedgerError, NameConflict, require_by
from paperlake.operators.works import display_title

KEYS = ("file_hash", "path")
KEPT = ("filename", "title", "citekey")  # what a member remembers of its paper
SCHEMA = (
    "kind string, op string, batch bigint, batch_id string, collection_id string, member_id bigint, name string, name_key string, "
    "note string, file_hash string, path string, filename string, title string, citekey string, by string, why string, "
    "at timestamp_ntz, undoes string, detail string, n bigint"
)


class UnknownCollection(LedgerError):
    code = "unknown_collection"


class UndoConflict(LedgerError):
    code = "undo_conflict"


def clean_name(name: str | None) -> str:
    cleaned = unicodedata.normalize("NFC", name or "").strip()
    if not cleaned:
        raise InvalidArgument("a collection needs a name")
    return cleaned


def name_key(name: str) -> str:
    return clean_name(name).casefold()


def collections_now(events: DataFrame) -> DataFrame:
    """(collection_id, name, name_key, note, created_by, created_at, live) of every collection ever made."""
    of = events.where("kind = 'collection'").groupBy("collection_id")
    return of.agg(
        latest(F.col("name"), ("create", "rename")).alias("name"), latest(F.col("name_key"), ("create", "rename")).alias("name_key"),
        latest(F.col("note"), ("create",)).alias("note"), latest(F.col("by"), ("create",)).alias("created_by"), latest(F.col("at"), ("create",)).alias("created_at"),
        (latest(F.col("op"), ("create", "delete", "restore")) != "delete").alias("live"),
    )


def members_now(events: DataFrame) -> DataFrame:
    """(member_id, collection_id, keys, added_by, added_at, why, batch_id, live) of every membership ever made."""
    kept = F.struct(*KEYS, *KEPT)
    added = F.struct("collection_id", F.col("by").alias("added_by"), F.col("at").alias("added_at"), "why", "batch_id")
    of = events.where("kind = 'member'").groupBy("member_id").agg(
        latest(kept, ("add", "rekey")).alias("k"), latest(added, ("add",)).alias("a"), (latest(F.col("op"), ("add", "remove", "restore")) != "remove").alias("live")
    )
    return of.select("member_id", "k.*", "a.*", "live")


def resolved(members: DataFrame, papers: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Members with the paper they are now (paper_id, status found, ambiguous or missing)."""
    return attach(members, match(members, papers, live))


class Collections(Ledger):
    table, schema = "collection_events", SCHEMA

    # --- reading

    def _holder(self, name: str):
        return collections_now(self.events()).where("live").where(F.col("name_key") == name_key(name)).first()

    def _find(self, name: str):
        row = self._holder(name)
        if row is None:
            raise UnknownCollection(name)
        return row

    def _members(self, collection_id: str) -> DataFrame:
        return members_now(self.events()).where("live").where(F.col("collection_id") == collection_id)

    def list(self, papers: DataFrame | None = None, live: DataFrame | None = None) -> DataFrame:
        """Live collections by name with their number of members, and with papers also how many resolve."""
        members = members_now(self.events()).where("live")
        counts = [F.count("*").alias("count")]
        if papers is not None:
            members = resolved(members, papers, live)
            counts += [F.countDistinct("paper_id").alias("resolved"), F.count_if(F.col("status") == "missing").alias("missing"), F.count_if(F.col("status") == "ambiguous").alias("ambiguous")]
        names = ["count", "resolved", "missing", "ambiguous"][: len(counts)]
        out = collections_now(self.events()).where("live").join(members.groupBy("collection_id").agg(*counts), "collection_id", "left")
        return out.fillna(0, names).orderBy("name_key").drop("name_key", "live")

    def resolve(self, name: str, papers: DataFrame, live: DataFrame | None = None) -> DataFrame:
        """Members with their present paper, display title and status; two that are one paper now count once."""
        found = resolved(self._members(self._find(name)["collection_id"]), papers, live)
        shown = papers.select(F.col("id").alias("paper_id"), display_title().alias("display_title"))
        once = found.where("paper_id is not null").dropDuplicates(["paper_id"]).unionByName(found.where("paper_id is null"))
        return once.join(shown, "paper_id", "left").drop("live").orderBy("added_at", "member_id")

    def collections_for(self, ids: DataFrame, papers: DataFrame, live: DataFrame | None = None) -> DataFrame:
        """(paper_id, collection_id, name, …) of the given papers; an ambiguous member counts for none."""
        found = resolved(members_now(self.events()).where("live"), papers, live).join(ids.select(F.col("id").alias("paper_id")).distinct(), "paper_id", "left_semi")
        names = collections_now(self.events()).where("live").select("collection_id", "name", "note")
        return found.select("paper_id", "collection_id", "added_by", "added_at", "why").dropDuplicates(["paper_id", "collection_id"]).join(names, "collection_id").orderBy("paper_id", "name")

    def history(self, limit: int = 50, name: str | None = None) -> DataFrame:
        """Batches, newest first; a name covers deleted collections that had it too."""
        if name is None:
            return super().history(limit)
        ids = collections_now(self.events()).where(F.col("name_key") == name_key(name)).select("collection_id")
        if ids.first() is None:
            raise UnknownCollection(name)
        return super().history(2**31 - 1).join(ids, "collection_id", "left_semi").orderBy(F.desc("batch")).limit(limit)

    # --- writing

    def _about(self, op: str, by: str, c, **values: str | None) -> DataFrame:
        row = self.spark.range(1).select(F.lit("collection").alias("kind"), F.lit(op).alias("op"), F.lit(c).alias("collection_id"), F.lit(by).alias("by"), self.now.alias("at"))
        return self.rows(row, **{k: F.lit(v) for k, v in values.items()})

    def create(self, name: str, by: str, note: str | None = None) -> str:
        by, name = require_by(by), clean_name(name)
        if self._holder(name) is not None:
            raise NameConflict(name)
        c = uuid.uuid4().hex[:12]
        return self.commit("create", by, [self._about("create", by, c, name=name, name_key=name_key(name), note=note)], collection_id=c, name=name)

    def rename(self, name: str, new: str, by: str) -> str:
        by, new, c = require_by(by), clean_name(new), self._find(name)
        holder = self._holder(new)
        if holder is not None and holder["collection_id"] != c["collection_id"]:
            raise NameConflict(new)
        row = self._about("rename", by, c["collection_id"], name=new, name_key=name_key(new))
        return self.commit("rename", by, [row], collection_id=c["collection_id"], name=new, detail=c["name"])

    def delete(self, name: str, by: str) -> str:
        """The collection goes, its members stay, so undoing brings them back."""
        by, c = require_by(by), self._find(name)
        held = self._members(c["collection_id"]).count()
        return self.commit("delete", by, [self._about("delete", by, c["collection_id"])], held, collection_id=c["collection_id"], name=c["name"])

    def add(self, name: str, ids: DataFrame, papers: DataFrame, by: str, why: str | None = None, live: DataFrame | None = None) -> tuple[str, DataFrame]:
        """(batch, (id, outcome added, already_present or not_found)); adding twice changes nothing.

        A member that the id resolves to under an older key takes the present key, unless
        another member has it.
        """
        by, c = require_by(by), self._find(name)
        now = resolved(self._members(c["collection_id"]), papers, live)
        title = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("title_from_layout"))
        asked = papers.join(ids.select("id").distinct(), "id", "left_semi").select("id", *KEYS, "filename", title.alias("title"), "citekey")
        held = now.where("paper_id is not null").groupBy(F.col("paper_id").alias("id")).agg(F.min_by(F.struct("member_id", *(F.col(k).alias(f"old_{k}") for k in KEYS)), F.struct("added_at", "member_id")).alias("m"))
        keys = now.select(*KEYS, F.lit(True).alias("key_held")).distinct()
        told = asked.join(held, "id", "left").join(keys, list(KEYS), "left")
        fresh = told.where("m is null and key_held is null").dropDuplicates(list(KEYS))
        drifted = told.where("m is not null and key_held is null").where(~(F.col("file_hash").eqNullSafe(F.col("m.old_file_hash")) & F.col("path").eqNullSafe(F.col("m.old_path"))))
        batch_id = uuid.uuid4().hex[:12]
        common = {"kind": F.lit("member"), "collection_id": F.lit(c["collection_id"]), "by": F.lit(by), "why": F.lit(why), "at": self.now}
        made = self.rows(fresh, op=F.lit("add"), member_id=F.xxhash64(F.lit(batch_id), *KEYS), **common)
        moved = self.rows(drifted, op=F.lit("rekey"), member_id=F.col("m.member_id"), **common)
        there = told.select("id", F.when(F.col("m").isNull() & F.col("key_held").isNull(), "added").otherwise("already_present").alias("outcome"))
        report = materialized(ids.select("id").distinct().join(there, "id", "left").select("id", F.coalesce("outcome", F.lit("not_found")).alias("outcome")))
        added = report.where("outcome = 'added'").count()
        return self.commit("add", by, [made, moved], added, batch_id=batch_id, collection_id=c["collection_id"], name=c["name"], why=why), report

    def remove(self, name: str, ids: DataFrame, papers: DataFrame, by: str, live: DataFrame | None = None) -> tuple[str, DataFrame]:
        """(batch, (id, outcome removed, ambiguous or not_found)).

        An id may be what a member resolves to now, or what it resolved to before its file
        moved; an id that is only one of several candidates is reported, not guessed.
        """
        by, c = require_by(by), self._find(name)
        members = self._members(c["collection_id"])
        now = resolved(members, papers, live).where("paper_id is not null").select("member_id", F.col("paper_id").alias("id"), F.lit(0).alias("stale"))
        before = resolved(members, papers).where("paper_id is not null").select("member_id", F.col("paper_id").alias("id"), F.lit(1).alias("stale"))
        hits = ids.select("id").distinct().join(now.unionByName(before).groupBy("member_id", "id").agg(F.min("stale").alias("stale")), "id")
        first = hits.groupBy("id").agg(F.min("stale").alias("least"))
        hits = materialized(hits.join(first, "id").where("stale = least").select("id", "member_id"))
        unclear = resolved(members, papers, live).where("status = 'ambiguous'")
        either = [unclear.select(k).join(papers.select("id", k), k).select("id") for k in KEYS]  # two equi-joins, not one with an or
        contested = either[0].union(either[1]).distinct().withColumn("contested", F.lit(True))
        told = ids.select("id").distinct().join(hits.select("id", F.lit(True).alias("hit")).distinct(), "id", "left").join(contested, "id", "left")
        report = materialized(told.select("id", F.when(F.col("hit"), "removed").when(F.col("contested"), "ambiguous").otherwise("not_found").alias("outcome")))
        rows = self.rows(hits.select("member_id").distinct(), kind=F.lit("member"), op=F.lit("remove"), collection_id=F.lit(c["collection_id"]), by=F.lit(by), at=self.now)
        return self.commit("remove", by, [rows], collection_id=c["collection_id"], name=c["name"]), report

    def undo(self, batch_id: str, by: str) -> tuple[str, DataFrame]:
        """(batch, (file_hash, path, filename, reason) of what could no longer be reversed)."""
        by, head = require_by(by), self.undone(batch_id)
        op, c = head["op"], head["collection_id"]
        events = self.events()
        here = collections_now(events).where(F.col("collection_id") == c).first()
        nothing = self.spark.createDataFrame([], "file_hash string, path string, filename string, reason string")
        if op != "delete" and here is not None and not here["live"]:
            raise UndoConflict(f"{here['name']} is deleted; undo that first")
        if op in ("add", "remove"):
            rows, skipped = undo_members(events, batch_id, op)
            rows = self.rows(rows, kind=F.lit("member"), op=F.lit("remove" if op == "add" else "restore"), collection_id=F.lit(c), by=F.lit(by), at=self.now)
            skipped = materialized(skipped)
            return self.commit("undo", by, [rows], collection_id=c, name=here["name"], undoes=batch_id), skipped
        if op == "rename":
            if here["name"] != head["name"]:
                raise UndoConflict(f"renamed to {here['name']} since")
            self._free(head["detail"], c)
            row = self._about("rename", by, c, name=head["detail"], name_key=name_key(head["detail"]))
        elif op == "delete":
            self._free(here["name"], c)
            row = self._about("restore", by, c)
        elif op == "create":
            if self._members(c).first() is not None:
                raise UndoConflict("the collection has members that this batch did not add")
            row = self._about("delete", by, c)
        else:
            raise LedgerError(f"a {op} batch cannot be undone")
        return self.commit("undo", by, [row], collection_id=c, name=here["name"], undoes=batch_id), nothing

    def _free(self, name: str, c: str) -> None:
        holder = self._holder(name)
        if holder is not None and holder["collection_id"] != c:
            raise UndoConflict(f"the name {name} is taken")

    def refresh(self, papers: DataFrame, live: DataFrame | None = None) -> dict[str, int]:
        """Keys of moved members brought up to date, deleted collections' too; counts of what was seen."""
        now = materialized(resolved(members_now(self.events()).where("live"), papers, live))
        moved, report = drifted_keys(now, papers, ["collection_id"])
        if report["updated"]:
            rows = self.rows(moved, kind=F.lit("member"), op=F.lit("rekey"), by=F.lit("refresh"), at=self.now)
            report["batch_id"] = self.commit("refresh", "refresh", [rows], report["updated"])
        return report


def undo_members(events: DataFrame, batch_id: str, op: str) -> tuple[DataFrame, DataFrame]:
    """((member_id) that undoing an add or remove batch reverses, the rest with the reason)."""
    own = events.where("kind = 'member'").where((F.col("batch_id") == batch_id) & (F.col("op") == op)).select("member_id")
    states = members_now(events)
    mine = states.join(own, "member_id", "left_semi")
    if op == "add":
        blocked, reason = ~F.col("live"), "already_removed"
    else:
        held = states.where("live").select(F.col("collection_id").alias("_c"), *KEYS, F.lit(True).alias("held")).distinct()
        mine = attach(mine, held).where("_c is null or _c = collection_id or live").groupBy(*states.columns).agg(F.max(F.col("held") & (F.col("_c") == F.col("collection_id"))).alias("held"))
        blocked, reason = F.col("live") | F.coalesce("held", F.lit(False)), "re_added"
    return mine.where(~blocked).select("member_id"), mine.where(blocked).select(*KEYS, "filename", F.lit(reason).alias("reason"))


def drifted_keys(now: DataFrame, papers: DataFrame, scope: list[str]) -> tuple[DataFrame, dict]:
    """(entities (member_id or item_id, new keys) whose paper has other keys now, counts); a key that another has is left."""
    title = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("title_from_layout"))
    keys = papers.select(F.col("id").alias("paper_id"), *(F.col(k).alias(f"new_{k}") for k in KEYS), F.col("filename").alias("new_filename"), title.alias("new_title"), F.col("citekey").alias("new_citekey"))
    moved = now.where("paper_id is not null").join(keys, "paper_id").where(~(F.col("file_hash").eqNullSafe(F.col("new_file_hash")) & F.col("path").eqNullSafe(F.col("new_path"))))
    held = now.select(*scope, *(F.col(k).alias(f"new_{k}") for k in KEYS), F.lit(True).alias("held")).distinct()
    told = materialized(moved.join(held, [*scope, *(f"new_{k}" for k in KEYS)], "left"))
    free = told.where("held is null").dropDuplicates([*scope, *(f"new_{k}" for k in KEYS)])
    free = free.drop(*KEYS, *KEPT).withColumnsRenamed({f"new_{k}": k for k in (*KEYS, *KEPT)})
    seen = {r["status"]: r["n"] for r in now.groupBy("status").agg(F.count("*").alias("n")).collect()}
    updated = free.count()
    return free, {"checked": sum(seen.values()), "updated": updated, "collided": told.count() - updated, "missing": seen.get("missing", 0), "ambiguous": seen.get("ambiguous", 0)}


def materialized(df: DataFrame) -> DataFrame:
    from paperlake.plans.lineage import materialize

    return materialize(df, "ledger")
