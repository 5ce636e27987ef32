import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paperlake import queries
from paperlake.functions.query import Field, First, Near, QuerySyntaxError, parse_syntax
from paperlake.functions.titles import similarity
from paperlake.operators import chunking, frontmatter, grep, layout, link, metadata, process, repairs, search
from paperlake.operators.index import KeywordIndex
from paperlake.plans.catalog import Catalog
from paperlake.plans.lineage import materialize, release
from paperlake.plans.numbering import numbered
from paperlake.sources import config, providers, readers


def docs(spark, rows):
    return search.tokenized(spark.createDataFrame(rows, "id bigint, text string"), "id", "text")


def test_index_agrees_with_scanning_and_is_maintained(spark, tmp_path):
    rows = [(1, "zebra four zebra"), (2, "zebra one policy"), (3, None), (4, "adaptive change in climate change"), (5, "policy change")]
    index = KeywordIndex(Catalog(spark, str(tmp_path))).rebuild(docs(spark, rows))
    for q in ("zebra", "zebra NOT one", "adapt*", '"climate change"', "policy OR zebra change", "change change", '"in clim"*', "nothing", "", '"'):
        assert [tuple(r) for r in search.bm25(index, q).collect()] == [tuple(r) for r in search.bm25(docs(spark, rows), q).collect()], q
    asked = spark.createDataFrame([(0, "zebra policy"), (1, "change"), (2, "nothing at all")], "q_idx bigint, q string")
    got = {(r.q_idx, r.doc_id): r.score for r in index.batch(asked).collect()}
    assert got == {(0, r.doc_id): r.score for r in search.bm25(index, "zebra OR policy").collect()} | {(1, r.doc_id): r.score for r in search.bm25(index, "change").collect()}
    index.refresh(docs(spark, [(2, "quokka"), (6, "zebra")]))
    assert {r.doc_id for r in search.bm25(index, "zebra").collect()} == {1, 6} and index.stats()[0] == 5
    index.delete(spark.createDataFrame([(1,)], "doc_id bigint"))
    assert {r.doc_id for r in search.bm25(index, "zebra").collect()} == {6} and index.terms().where("term = 'four'").count() == 0


def test_index_syntax(spark):
    rows = spark.createDataFrame([(1, "Ice melts", "sea ice melts fast"), (2, "Cold seas", "ice of the far cold north melts"), (3, None, "nothing")], "id bigint, title string, text string")
    d = search.fielded(rows, "id", title=F.col("title"), text=F.col("text"))
    hits = lambda q: {r.doc_id for r in search.syntax_matches(d, q).collect()}
    assert hits("title:ice") == {1} and hits("ice") == {1, 2} and hits("-title:ice") == {1, 2} and hits("{title text}:cold") == {2}
    assert hits("NEAR(ice melts, 2)") == {1} and hits("NEAR(melts ice, 5)") == {1, 2} and hits("^ice") == {1, 2} and hits("^sea") == {1}
    assert hits("(ice OR nothing) NOT cold") == {1, 3} and hits("mel*") == {1, 2} and hits("") == set()
    for bad in ("(", "title:", "NEAR(a b, x)", "a AND", '"open', "nothing:x", "* a"):
        with pytest.raises(QuerySyntaxError):
            hits(bad)
    assert isinstance(parse_syntax("title:x"), Field) and isinstance(parse_syntax("^x"), First) and isinstance(parse_syntax("NEAR(x y)"), Near)


def test_grep_overlaps_and_texts_without_chunks(spark):
    needle = "members are selected by lottery"
    chunks = spark.createDataFrame([(1, 0, "x " * 200 + needle + " now"), (1, 1, needle + " now and then " + needle), (3, 0, None)], "doc_id bigint, chunk_index int, text string")
    texts = spark.createDataFrame([(1, needle), (2, "a " + needle), (3, "b " + needle), (4, None)], "paper_id bigint, raw_text string")
    rows = grep.searched(chunks, texts)
    hits, more, missing = grep.report(grep.grep(rows, needle), 2, spark.createDataFrame([(1,), (2,), (4,)], "doc_id bigint"))
    assert [(r.doc_id, r.chunk_index, r.start) for r in grep.grep(rows, needle).collect()] == [(1, 0, 400), (1, 1, len(needle) + 14), (2, None, 2)]
    assert hits.count() == 2 and more and [r.doc_id for r in missing.collect()] == [4]


def test_front_matter_titles(spark):
    head = "Journal of Shared Mastheads\n"
    rows = [(n, head + f"A measured account of orchards number {w}\nand their keepers in {w}\nAnn Q. Berg, Carl Dahl\nDepartment of Trees, University X\nAbstract\nA very long first sentence of the abstract itself.") for n, w in enumerate(("one", "two", "six"))]
    got = {r.id: r.guess for r in frontmatter.title_guesses(spark.createDataFrame([*rows, (9, None), (10, "short")], "paper_id bigint, raw_text string")).collect()}
    assert got[0] == "A measured account of orchards number one and their keepers in one" and got[9] is None and got[10] is None
    assert frontmatter.is_byline("Jane Doe and Ann Roe") and not frontmatter.is_byline("What Is Actually Being Annotated?")


def test_repairs(spark):
    rows = [(1, '["A B", " "]', "2024-01-02 03:04:05"), (2, "Doe, J.; Roe, A.", "2024-01-02T03:04:05+00:00"), (3, None, None), (4, "", "x"), (5, "[broken", None)]
    df = spark.createDataFrame(rows, "id bigint, authors string, stamp string").withColumns({c: F.lit(None).cast("string") for c in ("title", "metadata_source", "abstract")}).withColumn("metadata_suspect", F.lit(True)).withColumn("metadata_enriched_at", F.when(F.col("id") == 3, "t"))
    out, told = repairs.repaired(df.withColumn("abstract", F.when(F.col("id") == 4, "left")), ("stamp",))
    by = {r.id: r for r in out.collect()}
    assert by[2].authors == '["Doe, J.","Roe, A."]' and by[1].authors == rows[0][1] and by[1].stamp == "2024-01-02T03:04:05+00:00" and by[3].metadata_source == "none:legacy" and by[4].abstract is None
    assert {(r.id, r.repair) for r in told.collect()} == {(2, "authors"), (4, "authors"), (5, "authors"), (1, "stamp"), (4, "orphan_abstract"), (3, "legacy_miss")}
    assert repairs.repaired(out.withColumn("metadata_enriched_at", F.lit(None).cast("string")), ("stamp",))[1].count() == 0
    one = spark.createDataFrame([({"world": [1], "hello": [0, 2]}, "HTTPS://doi.org/10.1/Ab", "doe-roe-et-al-2001-x.pdf", 1536, 125)], "m map<string, array<int>>, doi string, f string, n bigint, s bigint")
    surname, year = repairs.file_name_parts(F.col("f"))
    r = one.select(repairs.rebuilt_abstract(F.col("m")).alias("a"), repairs.cased_doi(F.col("doi")).alias("d"), surname.alias("w"), year.alias("y"), repairs.shown_size(F.col("n")).alias("n"), repairs.shown_duration(F.col("s")).alias("s"), repairs.shown_share(F.lit(1), F.lit(8)).alias("p"), repairs.parsed_authors(F.lit("A; B and C")).alias("l")).first()
    assert tuple(r) == ("hello world hello", "10.1/Ab", "doe", 2001, "1.5 KB", "2m 5s", "12.5%", ["A", "B", "C"])


def test_layout_rules():
    lines = [(20.0, 9.0, "Journal of Orchard Studies", False), (60.0, 18.0, "A Study of Orchards and", False), (84.0, 18.0, "Their Keepers", False), (120.0, 12.0, "Jane Q. Doe, Ann Roe", False), (300.0, 10.0, "body text", False)]
    assert layout.pick(lines, 10.0) == ("A Study of Orchards and Their Keepers", "high")
    assert layout.pick([(10.0, 10.0, "Copyright 2001 All rights reserved", False)], 10.0) == (None, None)
    assert layout.clean_title("T h e  T i t l e †") == "The Title" and layout.clean_title("Some name Some name") == "Some name"
    page = [(10.0, "89 Federal Register / Vol. 89, No. 1", False), (50.0, "DEPARTMENT OF TREES", True), (60.0, "Rules for AI-", True), (70.0, "Assisted Orchards", True), (80.0, "AGENCY: Trees.", False)]
    assert layout.gazette_title(page) == "Rules for AI-Assisted Orchards" and layout.gazette_title(page[1:]) is None
    assert layout.is_garbled("(cid:12) abc") and not layout.is_garbled("Ein Titel über Gärten")


LIB = "id bigint, path string, filename string, file_hash string, file_size bigint, file_modified timestamp_ntz, has_text boolean, has_markdown boolean, has_embeddings boolean, has_chunk_embeddings boolean, needs_ocr boolean, is_scanned boolean, is_encrypted boolean, title string, error_count int, updated_at timestamp_ntz"


def test_pipeline(spark):
    time = F.lit("2026-01-01").cast("timestamp_ntz")
    rows = [(1, "a.pdf", "a.pdf", "h1", 5, None, True, True, True, True, False, False, False, "Old", 0, None), (2, "b.pdf", "b.pdf", "h2", 5, None, True, True, True, True, False, False, False, "B", 0, None)]
    papers = spark.createDataFrame(rows, LIB).withColumn("file_modified", time)
    text = spark.createDataFrame([(1, "old", "old", 3, 3), (2, "b", "b", 1, 1)], "paper_id bigint, raw_text string, markdown string, text_length bigint, markdown_length bigint")
    chunks = spark.createDataFrame([(10, 1, 0, None, 1, 1, "old", 0), (11, 2, 0, None, 1, 1, "b", 0)], "chunk_id bigint, doc_id bigint, chunk_index int, section_header string, page_start int, page_end int, text string, char_offset bigint")
    vectors = spark.createDataFrame([(10, [1.0]), (11, [1.0])], "chunk_id bigint, embedding array<float>")
    files = spark.createDataFrame([("a.pdf", 6, "new"), ("c.pdf", 1, "h3"), ("d.pdf", 1, "h4")], "path string, length bigint, hash string").withColumn("modified", F.lit("2026-02-01").cast("timestamp_ntz"))

    def reader(path):
        if path == "d.pdf":
            raise ValueError("broken")
        return f"text of {path}", f"## Head\n\ntext of {path}", ["m", "m"]

    lib = process.pipeline(process.Library(papers, text, chunks, vectors), files, reader)
    got = {r.filename: r for r in lib.papers.collect()}
    assert lib.report["ingest"] == {"new": 2, "changed": 1, "touched": 0, "unchanged": 0, "missing": 1, "evicted": 0}
    assert lib.report["process"] == {"total": 3, "succeeded": 2, "failed": 1} and lib.report["embedded"] == 2
    assert got["d.pdf"].error_count == 1 and not got["d.pdf"].has_text and got["c.pdf"].has_chunk_embeddings and got["c.pdf"].id == 3 and got["b.pdf"].has_text
    assert {r.doc_id: r.text for r in lib.chunks.collect()} == {1: "text of a.pdf", 2: "b", 3: "text of c.pdf"}
    assert lib.chunk_vec.count() == 3 and {r.paper_id for r in lib.paper_text.collect()} == {1, 2, 3}
    again = process.process(lib, spark.createDataFrame([(4, "## Page 3\n\nscan", "## Page 3\n\nscan", None)], "id bigint, raw_text string, markdown string, error string"), ocr=True)
    assert [r.page_start for r in again.chunks.where("doc_id = 4").collect()] == [3]
    assert process.reset_errors(again.papers, spark.createDataFrame([(4,)], "id bigint")).where("id = 4").first().error_count == 0
    dry = process.pipeline(process.Library(papers, text, chunks, vectors), files, reader, dry_run=True)
    assert dry.papers.count() == 2 and dry.report["ingest"]["new"] == 2


def test_context_of_tiny_chunks(spark):
    chunks = spark.createDataFrame([(1, n, "ab") for n in range(400)] + [(1, 7, "ab"), (2, 0, "x" * 3000)], "doc_id bigint, chunk_index int, text string")
    got = {(r.doc_id, r.chunk_index): r.context for r in chunking.context(chunks, spark.createDataFrame([(1, 200), (1, 0), (2, 0), (2, 9)], "doc_id bigint, chunk_index int"), most=300).collect()}
    assert got[(1, 200)].count("ab") == 150 and got[(1, 0)].count("ab") == 150 and got[(2, 0)] == "x" * 3000 and len(got) == 3


def test_links_are_applied(spark, tmp_path):
    papers = spark.createDataFrame([(1, "a.pdf", "A title of orchards", None, "k1", "10.1/x"), (2, "b.pdf", "B title", None, None, None), (3, "c.pdf", "C title", None, None, None)], "id bigint, filename string, title string, title_from_layout string, citekey string, doi string").withColumn("authors", F.lit("Doe, Jane")).withColumn("year", F.lit(2001))
    bib = spark.createDataFrame([(10, "k2"), (11, "K1")], "entry_id bigint, citekey string")
    matches = spark.createDataFrame([(1, 10, "certain"), (2, 10, "uncertain")], "id bigint, entry_id bigint, confidence string")
    keys = lambda df: {r.id: r.citekey for r in df.collect()}
    assert keys(link.apply_matches(papers, matches, bib)) == {1: "k1", 2: None, 3: None}
    assert keys(link.apply_matches(papers, matches, bib, include_uncertain=True, force=True)) == {1: "k2", 2: "k2", 3: None}
    found = spark.createDataFrame([(2, "new", None), (3, "NEW", None)], "id bigint, citekey string, owner_id bigint")
    out, report = link.apply_suggestions(papers, found, spark.createDataFrame([(0, 3), (1, 2), (2, 1)], "pos bigint, id bigint"))
    assert {r.id: r.outcome for r in report.collect()} == {3: "applied", 2: "refused", 1: "no_suggestion"} and keys(out) == {1: "k1", 2: None, 3: "NEW"}
    audited = spark.createDataFrame([(1, 11, "stored", 0.1, 0.2)], "id bigint, entry_id bigint, basis string, score double, similarity double")
    out, refused = link.clear_audited(papers, audited, spark.createDataFrame([(1,), (2,)], "id bigint"), str(tmp_path / "log"))
    assert keys(out)[1] is None and [r.id for r in refused.collect()] == [2] and spark.read.json(str(tmp_path / "log")).first().citekey == "k1"
    entries, out = link.append_entries(papers, bib, spark.createDataFrame([(1,), (2,), (3,)], "id bigint"))
    assert keys(out) == {1: "k1", 2: "doe2001b", 3: "doe2001c"} and entries.count() == 2


def test_pull_tells_old_and_new(spark):
    head = "The true title of orchards. doi 10.1/printed"
    papers = spark.createDataFrame([(1, "k", None, '["Ann Bee", "Dan Cee"]', 2000, "10.1/printed", None)], "id bigint, citekey string, title string, authors string, year int, doi string, metadata_source string")
    bib = spark.createDataFrame([(5, "K", "The true title of orchards", "Bee, Ann and Cee, Dan", 2001, "10.1/other")], "entry_id bigint, citekey string, title string, authors string, year int, doi string")
    text = spark.createDataFrame([(1, head)], "paper_id bigint, raw_text string")
    (r,) = link.pull(papers, bib, text).collect()
    assert (r.action, r.changed, r.old, r.new) == ("pull", "title,year", {"title": "", "year": "2000"}, {"title": "The true title of orchards", "year": "2001"})
    assert [x.id for x in link.newly_titled(link.pull(papers, bib, text)).collect()] == [1]


def test_enrichment_drops_a_wrong_printed_doi(spark):
    papers = spark.createDataFrame([(1, "x.pdf", None, None, None, None)], "id bigint, filename string, title string, doi string, title_from_layout string, metadata_source string")
    works = spark.createDataFrame([("10.1234/cited", "Something else entirely about glaciers", '["Z"]', 1999)], "doi string, title string, authors string, year int")
    (r,) = metadata.enrich(papers, works, spark.createDataFrame([(1, "An orchard study of keepers\ndoi: 10.1234/cited")], "paper_id bigint, raw_text string")).collect()
    assert (r.metadata_source, r.suspect, r.doi) == ("provider:doi", True, None)


def test_small_sources(spark, tmp_path):
    path = str(tmp_path / "c.json")
    config.save(path, provider="x")
    config.save(path, bib_file="~/b.bib")
    assert config.load(path)["provider"] == "x" and not config.load(path)["bib_file"].startswith("~")
    with pytest.raises(config.UnknownSetting):
        config.save(path, nothing="x")
    providers.register("mine", lambda s: s.range(1))
    assert providers.get(spark, "mine")[1].count() == 1
    with pytest.raises(ValueError):
        providers.get(spark, "nothing")
    (tmp_path / "ids").write_text("3, 1\n3 2")
    assert [r.id for r in readers.read_ids(spark, str(tmp_path / "ids")).collect()] == [3, 1, 2]
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf" / "a.pdf").write_bytes(b"x")
    (tmp_path / "pdf" / "b.pdf").write_bytes(b"y")
    files, seen = readers.list_files(spark, str(tmp_path / "pdf"))
    first = {r.path: r.hash for r in files.collect()}
    assert seen.count() == 2 and len(set(first.values())) == 2
    papers = files.where("path like '%a.pdf'").select("path", F.col("length").alias("file_size"), F.col("modified").alias("file_modified"), F.lit("kept").alias("file_hash"))
    again = {r.path[-5:]: r.hash for r in readers.list_files(spark, str(tmp_path / "pdf"), papers=papers)[0].collect()}
    assert again["a.pdf"] == "kept" and again["b.pdf"] in first.values()


def test_numbers_and_copies(spark):
    df = spark.range(1000).select((F.lit(1000) - F.col("id")).alias("x")).repartition(7)
    got = [r.n for r in numbered(df, ["x"], start=5).orderBy("x").collect()]
    assert got == list(range(5, 1005)) and numbered(df.limit(0), ["x"]).count() == 0
    assert materialize(spark.range(3)).count() == 3 and callable(release)


def test_nearest_of_more_queries_than_one_pass_holds(spark, monkeypatch):
    monkeypatch.setattr(search, "MAX_QUERIES", 7)
    monkeypatch.setattr(search, "MAX_KEPT", 15)  # 5 queries a pass
    rng = np.random.default_rng(1)
    own = rng.normal(size=(60, 4)).astype(np.float32)
    x = np.concatenate([own, own, own])  # copies tie, the smaller id counts
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<float>").repartition(3)
    asked = rows.where("id % 5 = 0").select(F.col("id").alias("q_idx"), F.col("vec").alias("qvec"))
    got = sorted((r.q_idx, r["rank"], r.id, r.score) for r in search.knn(rows, asked, k=3).collect())
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    want = []
    for q in range(0, len(x), 5):
        s = np.round(unit @ unit[q], 4)
        want += [(q, n + 1, int(i), float(s[i])) for n, i in enumerate(np.lexsort((np.arange(len(x)), -s))[:3])]
    assert got == want
    assert search.scores(rows, asked).count() == len(x) * 36


def test_suggestions_align_only_titles_whose_words_the_text_holds(monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 9)))
    stock = [word() for _ in range(60)]
    us = [" ".join(rng.choices(stock, k=rng.randint(2, 9))) for _ in range(70)] + ["x " + " ".join(stock[:50])]
    ts = [" ".join(w[1:] if rng.random() < 0.2 else w for w in rng.choice(us).split()) for _ in range(130)]
    held = [sorted({hash(w) for w in rng.sample(stock, 30)} | {hash(w) for w in t.split() if rng.random() < 0.9}) for t in ts]
    asked = [[hash(w) for w in u.split()] for u in us]
    asked[5] = []
    x, y = pd.DataFrame({"id": range(130), "title": ts, "words": held}), pd.DataFrame({"entry_id": range(71), "bib_title": us, "words": asked})
    share = lambda a, b: sum(w in held[a] for w in asked[b]) / len(asked[b]) if asked[b] else 0.0
    aligned, plain = [0], link._commons
    monkeypatch.setattr(link, "_commons", lambda t, u, j, k: (aligned.__setitem__(0, aligned[0] + len(j)), plain(t, u, j, k))[1])
    for least in (0.6, 0.0):
        aligned[0] = 0
        got = {tuple(r) for r in link.held_pairs(x, y, 0.75, least).itertuples(index=False)}
        want = {(a, b) for a in range(130) for b in range(71) if similarity(ts[a], us[b]) >= 0.75 and share(a, b) >= least}
        assert got == want and (least or len(got) > 100)
        assert aligned[0] <= sum(share(a, b) >= least - 0.001 for a in range(130) for b in range(71))
    j, k = np.repeat(np.arange(130), 71), np.tile(np.arange(71), 130)
    assert plain(ts, us, j, k).tolist() == [link._common(ts[a], link._places(us[b])) for a, b in zip(j, k)]


def test_suggestions_are_made_once_for_applying(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    def seen(key):
        made.add(1)
        return key

    rows = spark.createDataFrame([(1, "a2001x", None), (2, "a2001x", None), (3, "b2002y", 9)], "id bigint, citekey string, owner_id bigint")
    found = rows.withColumn("citekey", F.udf(seen, "string").asNondeterministic()("citekey"))
    monkeypatch.setattr(queries, "link_suggest", lambda s, d: found)
    monkeypatch.setattr(queries, "papers", lambda s, d: spark.createDataFrame([(n, None) for n in (1, 2, 3, 4)], "id bigint, citekey string"))
    got = {tuple(r) for r in queries.link_apply_suggested(spark, "").collect()}
    assert got == {(1, "a2001x", "applied"), (2, "a2001x", "refused"), (3, "b2002y", "refused")}
    assert made.value == 3
