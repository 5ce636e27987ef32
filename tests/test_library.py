import os

import pytest
from pyspark.sql import functions as F

from paperlake import cli
from paperlake.api import Library
from paperlake.functions.query import QuerySyntaxError
from paperlake.functions.stem import porter
from paperlake.operators.search import trimmed
from paperlake.plans.catalog import Catalog, CatalogError
from paperlake.streaming.opens import run_available

ROOT = "/root/testdata/sf0.001"


def test_catalog(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path / "c"))
    with pytest.raises(CatalogError):
        cat.read("a")
    cat.write(a=spark.range(3), b=spark.range(1))
    old = cat.read("a")
    cat.write(a=spark.range(5))
    assert cat.read("a").count() == 5 and old.count() == 3 and cat.tables() == ["a", "b"]
    with cat.writing(), pytest.raises(CatalogError):
        cat.write(a=spark.range(1))


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")
def test_library(spark):
    lib = Library(spark, ROOT, embed=lambda q: [1.0] * 64)
    found = lib.search("glacier OR ballot OR harvest", limit=5, fold_works=True)
    got = found.results.collect()
    assert found.mode == "hybrid" and 0 < len(got) <= 5 and all(len(r.snippet or "") < 320 for r in got) and found.total >= len(got)
    assert lib.search("title:(", limit=5, syntax=True).mode == "vector_fallback"
    plain = Library(spark, ROOT).search("glacier OR ballot OR harvest", limit=5)
    assert plain.mode == "fts" and plain.results.count() == 5 and Library(spark, ROOT).search("authors:nobody", syntax=True).results.count() == 0
    with pytest.raises(QuerySyntaxError):
        Library(spark, ROOT).search("NEAR(a b", syntax=True)
    assert lib.semantic("x").mode == "cascade" and lib.semantic("x", documents_only=True).mode == "doc"
    assert lib.status().first().total == lib.table("papers").count()


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")
def test_command_line(spark, tmp_path, capsys):
    run = lambda *a: cli.main([ROOT, "--ledgers", str(tmp_path), *a], spark)
    assert run("status") == 0 and run("find", "no such fragment at all") == 2 and run("gaps", "--field", "nothing") == 64
    assert run("collection-create", "a", "--by", "me") == 0 and run("collection-create", "A", "--by", "me") == 1
    assert "name_conflict" in capsys.readouterr().err
    assert run("collection-add", "a", "--ids", "1 999999", "--by", "me") == 3 and run("info", "--ids", "1,999999") == 3
    with pytest.raises(SystemExit) as e:
        run("nothing")
    assert e.value.code == 64


def test_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 10:05:00"), (2, "2024-01-01 10:50:00"), (3, "2024-01-09 11:00:00")]
    df = spark.createDataFrame(rows, "open_id int, at string").select("open_id", F.to_timestamp("at").alias("opened_at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    run_available(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "out"), str(tmp_path / "chk"))
    assert [r.opens for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [2]


def test_stems_and_snippets():
    pairs = {"caresses": "caress", "relational": "relat", "hopping": "hop", "happy": "happi", "adoption": "adopt", "assembly": "assembl", "controlling": "control"}
    assert {w: porter(w) for w in pairs} == pairs
    text = "word " * 200 + "deliberation here " + "word " * 200
    assert "deliberation" in trimmed(text, "deliberations") and trimmed(text, "deliberations").startswith("...") and trimmed("short", "x") == "short"
