import pytest
from pyspark.sql import functions as F

from paperlake.operators import collections, inbox
from paperlake.operators.collections import Collections, UndoConflict, UnknownCollection, undo_members
from paperlake.operators.inbox import Inbox, ItemRetired, UnknownItem
from paperlake.operators.ledger import AlreadyUndone, InvalidArgument, NameConflict, UnknownBatch
from paperlake.plans.catalog import Catalog, CatalogError

PAPERS = "id bigint, file_hash string, path string, filename string, title string, title_from_layout string, citekey string"


@pytest.fixture
def papers(spark):
    return spark.createDataFrame([(n, f"h{n}", f"p{n}", f"f{n}.pdf", f"T{n}" if n < 3 else None, "L", f"k{n}") for n in range(1, 5)], PAPERS)


def ids(spark, *n):
    return spark.createDataFrame([(i,) for i in n], "id bigint")


def outcome(report):
    return {r.id: r.outcome for r in report.collect()}


def test_catalog_appends_swaps_and_locks(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "lib"))
    assert not c.has("t") and not (tmp_path / "lib").exists()
    c.write(t=spark.range(2))
    before = c.read("t")
    c.append(t=spark.range(3))
    assert c.read("t").count() == 5 and before.count() == 2
    c.write(t=spark.range(1))
    assert c.read("t").count() == 1 and c.tables() == ["t"]
    with c.writing(), pytest.raises(CatalogError):
        c.write(t=spark.range(1))
    with pytest.raises(CatalogError):
        c.read("x")


def test_collections(spark, papers, tmp_path):
    c = Collections(Catalog(spark, str(tmp_path)))
    c.create("Été", "me", "a note")
    with pytest.raises(NameConflict):
        c.create("ÉTÉ", "me")
    with pytest.raises(InvalidArgument):
        c.create("x", " ")
    with pytest.raises(UnknownCollection):
        c.delete("nothing", "me")
    batch, report = c.add("été", ids(spark, 1, 2, 9), papers, "me", "why")
    assert outcome(report) == {1: "added", 2: "added", 9: "not_found"}
    assert outcome(c.add("été", ids(spark, 2, 3), papers, "me")[1]) == {2: "already_present", 3: "added"}
    assert {r.paper_id for r in c.resolve("été", papers).collect()} == {1, 2, 3}
    gone, report = c.remove("été", ids(spark, 1, 4), papers, "me")
    assert outcome(report) == {1: "removed", 4: "not_found"}
    _, skipped = c.undo(batch, "me")  # paper 1 is gone already
    assert [(r.path, r.reason) for r in skipped.collect()] == [("p1", "already_removed")] and {r.paper_id for r in c.resolve("été", papers).collect()} == {3}
    c.undo(gone, "me")
    assert {r.paper_id for r in c.resolve("été", papers).collect()} == {1, 3}
    with pytest.raises(AlreadyUndone):
        c.undo(batch, "me")
    with pytest.raises(UnknownBatch):
        c.undo("nothing", "me")
    named = c.rename("été", "Autumn", "me")
    (row,) = c.list(papers).collect()
    assert (row["name"], row["count"], row.resolved, row.missing) == ("Autumn", 2, 2, 0)
    deleted = c.delete("autumn", "me")
    with pytest.raises(UndoConflict):
        c.undo(named, "me")
    c.create("autumn", "me")
    with pytest.raises(UndoConflict):
        c.undo(deleted, "me")
    assert [r.op for r in c.history(3).collect()] == ["create", "delete", "rename"] and c.history(50, "AUTUMN").count() >= 2
    assert c.history().where("undone_by is not null").count() == 2


def test_moved_files(spark, papers, tmp_path):
    c = Collections(Catalog(spark, str(tmp_path)))
    c.create("a", "me")
    c.add("a", ids(spark, 1, 2), papers, "me")
    moved = papers.withColumn("path", F.when(F.col("id") == 1, "new/p1").otherwise(F.col("path"))).where("id <> 2")
    assert {(r.paper_id, r.status) for r in c.resolve("a", moved).collect()} == {(1, "found"), (None, "missing")}
    report = c.refresh(moved)
    assert (report["checked"], report["updated"], report["missing"], report["collided"]) == (2, 1, 1, 0)
    assert c.refresh(moved)["updated"] == 0 and [r["name"] for r in c.collections_for(ids(spark, 1), moved).collect()] == ["a"]


def test_undo_of_a_removal_that_was_added_again(spark):
    rows = [("member", "add", 1, "a", "c", 1, "h", "p"), ("member", "remove", 2, "b", "c", 1, "h", "p"), ("member", "add", 3, "d", "c", 2, "h", "p")]
    names = "kind string, op string, batch bigint, batch_id string, collection_id string, member_id bigint, file_hash string, path string"
    events = spark.createDataFrame(rows, names)
    for x in ("filename", "title", "citekey", "by", "why"):
        events = events.withColumn(x, F.lit(None).cast("string"))
    events = events.withColumn("at", F.lit(None).cast("timestamp_ntz"))
    mine, skipped = undo_members(events, "b", "remove")
    assert mine.count() == 0 and [r.reason for r in skipped.collect()] == ["re_added"]
    mine, _ = undo_members(events.where("batch < 3"), "b", "remove")
    assert [r.member_id for r in mine.collect()] == [1]


def test_inbox(spark, papers, tmp_path):
    box = Inbox(Catalog(spark, str(tmp_path)), now=F.lit("2026-01-01").cast("timestamp_ntz"))
    first, report = box.enqueue(ids(spark, 1, 2, 9), papers, "me")
    got = {r.id: (r.item_id, r.outcome) for r in report.collect()}
    assert got[1][1] == "added" and got[9] == (None, "not_found")
    assert {r.id: r.outcome for r in box.enqueue(ids(spark, 1), papers, "me")[1].collect()} == {1: "already_present"}
    box.enqueue(ids(spark, 1), papers, "me", passage={"page": 3, "quote": "q"})
    with pytest.raises(InvalidArgument):
        box.enqueue(ids(spark, 1), papers, "me", passage={"page": 0})
    item = got[1][0]
    assert box.due(papers).count() == 3
    good = box.review(item, "good", "me")
    key = box.review(item, "key", "me")
    row = box.items(papers, "scheduled").where(F.col("item_id") == item).first()
    assert (row.interval_days, row.reviews, row.paper_id, row.status) == (7.0, 2, 1, "scheduled")
    with pytest.raises(UndoConflict):
        box.undo(good, "me")
    box.undo(key, "me")
    assert box.items(papers).where(F.col("item_id") == item).first().interval_days == 1.0
    done = box.review(item, "done", "me")
    with pytest.raises(ItemRetired):
        box.review(item, "good", "me")
    with pytest.raises(UnknownItem):
        box.review(12345, "good", "me")
    box.record_open(1, papers, "me", page=2, seconds=5.0)
    box.record_open(4, papers, "me")
    state = {r.paper_id: r for r in box.state_for(ids(spark, 1, 4), papers).collect()}
    assert (state[1].status, state[1].passages, state[1].opens) == ("due", 1, 1) and state[1].item_id != item  # the active passage speaks
    assert (state[4].status, state[4].item_id, state[4].opens) == (None, None, 1)
    again, _ = box.enqueue(ids(spark, 1), papers, "me")
    with pytest.raises(UndoConflict):
        box.undo(done, "me")
    box.undo(again, "me")
    box.undo(done, "me")
    assert box.items(papers, "done").count() == 0
    _, skipped = box.undo(first, "me")
    assert skipped.count() == 0 and box.items(papers, "all").count() == 1
    assert [r.op for r in box.history(1).collect()] == ["undo"] and box.refresh(papers)["updated"] == 0


def test_empty_ledgers(spark, papers, tmp_path):
    c, box = Collections(Catalog(spark, str(tmp_path / "a"))), Inbox(Catalog(spark, str(tmp_path / "a")))
    assert c.list().count() == 0 and box.items(papers).count() == 0 and c.history().count() == 0 and box.state_for(ids(spark, 1), papers).count() == 0
    assert not (tmp_path / "a").exists() and collections.SCHEMA and inbox.SCHEMA
