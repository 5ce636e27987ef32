"""Operators of the core on small tables."""

import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from paperlake.functions import packed, titles
from paperlake.functions.names import surnames
from paperlake.functions.query import literal, parse
from paperlake.operators import chunking, find, grep, identity, layout, ledger, library, link, metadata, queue, search
from paperlake.operators.components import components
from paperlake.operators.unpack import unpack
from paperlake.sources import readers, sinks


def names(text):
    return packed.extract(text, packed.resolve(packed.skeleton(text)))


@pytest.mark.parametrize(
    "text,want",
    [
        ("Doe, Jane and Roe, Ann", ["Doe, Jane", "Roe, Ann"]),
        ("Jane Doe, Ann Roe and Bob Poe", ["Jane Doe", "Ann Roe", "Bob Poe"]),
        ("Doe, J. K., Roe, A., et al.", ["Doe, J. K.", "Roe, A."]),
        ('["Jane D\\u00f6e", "Ann Roe"]', ["Jane Döe", "Ann Roe"]),
        ('["Jane Doe; Ann Roe"]', ["Jane Doe", "Ann Roe"]),
        ('"Doe, Jane";"Roe, Ann"', ["Doe, Jane", "Roe, Ann"]),
        ("'Doe, Jane','Roe, Ann'", ["Doe, Jane", "Roe, Ann"]),
        ("{Council of North and South} and Doe, Jane", ["Council of North and South", "Doe, Jane"]),
        ("J. Doe / A. Roe / ", ["J. Doe", "A. Roe"]),
        ("Jane Doe;; ; Ann Roe;", ["Jane Doe", "Ann Roe"]),
        ("Doe, Jr., Bob and others", ["Doe, Jr., Bob"]),
        ("de la Roe, Ann|van der Poe, Bob", ["de la Roe, Ann", "van der Poe, Bob"]),
        ("Ren{\\'e} D{\\'\\i}az & Ann O'Roe", ["Ren{\\'e} D{\\'\\i}az", "Ann O'Roe"]),
        ("", []), ("[]", []), (" et al. ", []),
    ],
)
def test_packed_names(text, want):
    assert names(text) == want


def test_unpack(spark):
    rows = [(1, "A. Bee; C. Dee"), (1, "A. Bee; C. Dee"), (2, None), (3, " "), (4, "; ".join(f"Ann{chr(97 + n % 26)} Roe" for n in range(3000)))]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "id bigint, authors string, pos int, name string")
    for limit in (1000, 0):  # broadcast rules and salted join
        got = unpack(df, "id", "authors", limit).collect()
        assert sorted((r.pos, r.name) for r in got if r.record_id == 1) == [(1, "A. Bee"), (1, "A. Bee"), (2, "C. Dee"), (2, "C. Dee")]
        assert max(r.pos for r in got) == 3000 and {r.record_id for r in got} == {1, 4}
    assert unpack(df.limit(0), "id", "authors").count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80))
def test_packed_never_fails(text):
    assert all(n.strip() for n in names(text))


def test_surnames_and_titles():
    assert surnames("Jane K. Döe; Ann van der Roe; Poe, Bob, Jr.") == ["doe", "vanderroe", "poe"]
    assert titles.ascii_title("Café — Über: Ones!") == "cafe uber ones" and titles.is_generic("review of the book")
    assert titles.agree("a b c d", "a b c d e f g h i j k l", "a b c d", "a b c d e f g h i j k l")


def test_queries_text():
    assert literal("climate AND cross-border") == '"climate" AND "cross-border"' and literal('say "hi') == '"say" "hi"' and literal("AND") == '"AND"'
    assert parse("a OR b c").kind == "or" and parse("***") is None and parse("a NOT b AND c").kind == "and"


def test_search_hostile_and_prefix(spark):
    df = spark.createDataFrame([(1, "zebra four"), (2, "zebra one policy"), (3, None), (4, "adaptive change climate")], "id bigint, text string")
    docs = search.tokenized(df, "id", "text")
    assert [r.doc_id for r in search.bm25(docs, "zebra NOT one").collect()] == [1]
    assert [r.doc_id for r in search.bm25(docs, "adapt*").collect()] == [4] and search.bm25(docs, '"climate change"').collect() == []
    for q in ("", '"', "*", "NOT", "AND OR", "a:b(c)^2", "'; drop", "\\", "NEAR("):
        search.bm25(docs, q).collect()


def test_components_random(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(n, n + 1) for n in range(100, 140)] + [(7, 7)]
    parent = {n: n for e in edges for n in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    want = {n: root(n) for n in parent if any(n in e and e[0] != e[1] for e in edges)}
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_grep_tiers(spark):
    rows = [(1, 0, "we select members by lottery"), (2, 0, "deep engage-\nment and **outrage** in “quotes” with ﬁre"), (3, 0, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, chunk_index int, text string")
    (hit,) = grep.grep(df, "members by lottery").collect()
    assert (hit.kind, hit.matched) == ("exact", "members by lottery")
    (hit,) = grep.grep(df, 'engagement and outrage in "quotes" with fire').collect()
    assert hit.kind == "normalized" and rows[1][2][hit.start : hit.end] == hit.matched


def test_find(spark):
    rows = [(1, "Mind games", None, '["Terry Flew"]', "flew2022digital", 2022, None, "a.pdf"), (2, "Other", None, '["Ondřej Filipec"]', None, 2019, "10.1/x", "b.pdf")]
    df = spark.createDataFrame(rows, "id bigint, title string, title_from_layout string, authors string, citekey string, year int, doi string, filename string")
    ids = lambda q: [(r.id, r.tier) for r in find.find(df, q).collect()]
    assert ids("Mind games") == [(1, 0)] and ids("Flew et al. (2022)") == [(1, 2)] and ids("ondrej FILIPEC") == [(2, 2)] and ids("https://doi.org/10.1/x") == [(2, 3)]


def test_schedule_and_undo(spark):
    cases = [(None, "key", 0, 7.0), (10.0, "key", 2, 30.0), (None, "good", 0, 1.0), (4.0, "good", 1, 8.0), (4.0, "later", 1, 6.0), (10.0, "doubt", 1, 2.0), (1.0, "doubt", 1, 1.0), (5.0, "done", 3, None)]
    df = spark.createDataFrame(cases, "p double, v string, n int, want double")
    assert all(r.got == r.want for r in df.withColumn("got", ledger.next_interval(F.col("p"), F.col("v"), F.col("n"))).collect())
    events = spark.createDataFrame([], "seq bigint, batch_id bigint, op string, collection string, paper_id bigint, by string")
    new = spark.createDataFrame([("c", 1), ("c", 2)], "collection string, paper_id bigint")
    once = ledger.add(events, new, "me")
    assert ledger.members(once).count() == 2 and ledger.add(once, new, "me").count() == once.count()
    undone = ledger.undo(once, 1, "me")
    assert ledger.members(undone).count() == 0
    with pytest.raises(ledger.AlreadyUndone):
        ledger.undo(undone, 1, "me")
    with pytest.raises(ledger.UnknownBatch):
        ledger.undo(once, 9, "me")
    with pytest.raises(ledger.InvalidArgument):
        ledger.add(once, new, " ")


def test_identity(spark):
    papers = spark.createDataFrame([(1, "h1", "p1"), (2, "h1", "p2"), (3, "h3", "p3")], "id bigint, file_hash string, path string")
    keys = spark.createDataFrame([("h1", "p1"), ("h1", "x"), ("x", "p3"), ("x", "y")], "file_hash string, path string")
    got = {(r.file_hash, r.path): (r.paper_id, r.status) for r in identity.match(keys, papers).collect()}
    assert got == {("h1", "p1"): (1, "found"), ("h1", "x"): (None, "ambiguous"), ("x", "p3"): (3, "found"), ("x", "y"): (None, "missing")}
    live = spark.createDataFrame([("p2",)], "path string")
    assert {r.paper_id for r in identity.match(keys.where("path = 'p1'"), papers, live).collect()} == {2}


def test_chunks_and_pages(spark):
    text = "Intro text here.\n\n## One\n\n" + "A sentence of some words. " * 200 + "\n\n### Two\n\n| a | b |\n| - | - |\n| 1 | 2 |\n"
    got = chunking.chunk_text(text)
    assert got[0][:2] == (None, "Intro text here.") and {h for h, _, _ in got} == {None, "One", "Two"} and all(len(t) <= 1800 for _, t, _ in got)
    assert all(text.startswith(t[:25], o) for _, t, o in got) and chunking.chunk_text("") == []
    pages = [f"page {w} " + " ".join(f"{w}{chr(97 + n)}word" for n in range(26)) for w in ("alpha", "beta", "gamma")]
    chunks = [pages[0][:150], pages[1][:100], "zzz", pages[2]]
    spans = chunking.map_pages(pages, chunks)
    assert [s[0] for s in spans] == [1, 2, 2, 3] and spans[2][2] == "interpolated" and chunking.map_pages([""], ["a"]) == [(None, None, "no_text")]


def test_layout(spark):
    rows = [(1, 1, 1, 0.0, 10.0, 18.0, False, "A Large Title"), (1, 1, 2, 0.0, 30.0, 18.0, False, "of Two Lines"), (1, 1, 3, 0.0, 60.0, 10.0, False, "body text " * 20)]
    df = spark.createDataFrame(rows, "doc_id bigint, page int, line int, x double, y double, size double, bold boolean, text string")
    (r,) = layout.layout_titles(df).collect()
    assert (r.title, r.confidence) == ("A Large Title of Two Lines", "high")


def test_files_notes_and_bib(spark, tmp_path):
    (tmp_path / "a.bib").write_text("@article{doe2020,\n title = {The {T}itle, with comma},\n author = \"Doe, Jane and Roe, Ann\",\n date = {2020-03},\n file = {:pdf/x.pdf:PDF}\n}\n@online{k2, title={B}, year=1999}\n")
    got = sorted((r.citekey, r.entry_type, r.title, r.year) for r in readers.read_bibtex(spark, str(tmp_path / "a.bib")).collect())
    assert got == [("doe2020", "article", "The {T}itle, with comma", 2020), ("k2", "online", "B", 1999)]
    notes = spark.createDataFrame([("n1", "see [[x/a.pdf|A]] and [b](b.pdf)\nsource: c.pdf\n")], "note string, text string")
    papers = spark.createDataFrame([(1, "a.pdf", "p/a.pdf"), (2, "z.pdf", "p/z.pdf")], "id bigint, filename string, path string")
    assert {r.ref for r in library.references(notes).collect()} == {"a.pdf", "b.pdf", "c.pdf"}
    assert {r.ref for r in library.orphans(notes, papers).collect()} == {"b.pdf", "c.pdf"} and [r.id for r in library.uncovered(notes, papers).collect()] == [2]
    kept, text = library.prune(papers, spark.createDataFrame([("p/a.pdf",)], "path string"), (spark.createDataFrame([(1,), (2,)], "paper_id bigint"), "paper_id"))
    assert [r.id for r in kept.collect()] == [1] and [r.paper_id for r in text.collect()] == [1]
    with pytest.raises(ValueError):
        library.prune(papers, papers.select("path").limit(0))
    assert readers.parse_ids("3, 1 3\n2") == [3, 1, 2]
    with pytest.raises(ValueError):
        readers.parse_ids("1 x")


def test_citekeys(spark):
    wanted = spark.createDataFrame([(1, "doe2020law"), (2, "Doe2020law"), (3, "roe1999art")], "id bigint, base string")
    taken = spark.createDataFrame([("DOE2020law",), ("doe2020lawa",)], "citekey string")
    got = {r.id: r.citekey for r in link.assign_citekeys(wanted, taken).collect()}
    assert got == {1: "doe2020lawb", 2: "Doe2020lawc", 3: "roe1999art"}


def test_metadata(spark):
    assert metadata.printed_doi("see 10.1234/cited.\ndoi: 10.5678/own.\n\nReferences\n10.9999/x") == "10.5678/own" and metadata.printed_doi(None) is None
    papers = spark.createDataFrame([(1, "Old", None, True)], "id bigint, title string, metadata_source string, metadata_suspect boolean")
    changes = spark.createDataFrame([(1, 1, "A"), (1, 2, "B")], "id bigint, seq int, title string")
    (r,) = metadata.set_by(papers, changes, "me", ["title"]).collect()
    assert (r.title, r.metadata_source, r.metadata_suspect) == ("B", "manual:me", False)


def test_filters_are_checked():
    with pytest.raises(ValueError):
        queue.condition(needs=("nothing",))


def test_sinks(spark):
    df = spark.createDataFrame([(0, 2, 7), (0, 1, 9), (1, 1, 7)], "q_idx int, rank int, id int")
    assert [r.id for r in sinks.first_seen(df).collect()] == [9, 7] and sinks.select_fields(df, ["id", "x"])[1] == ["x"]


def test_similar_titles_are_complete(spark, monkeypatch):
    monkeypatch.setattr(link, "BLOCK", 20, raising=False)  # several groups a length
    rng = random.Random(5)
    words = "turnout ballot quorum glacier permafrost tariff orchard referee statute marathon irrigation verdict".split()
    clean = [" ".join(rng.sample(words, rng.randrange(1, 8))) for _ in range(60)]

    def slips(t):
        for _ in range(rng.randrange(8)):
            k = rng.randrange(len(t))
            t = t[:k] + rng.choice(["", "x", "q ", t[k]]) + t[k + 1 :]
        return t

    papers, bib = [(n, slips(t)) for n, t in enumerate(clean)], [(n, slips(t)) for n, t in enumerate(clean)]
    p = spark.createDataFrame([(i, t, None, "", 2000) for i, t in papers], "id bigint, title string, title_from_layout string, filename string, year int")
    b = spark.createDataFrame([(i, t, 2000) for i, t in bib], "entry_id bigint, title string, year int")
    for least in (0.75, 0.85):
        want = {(i, j) for i, t in papers for j, u in bib if titles.similarity(titles.ascii_title(t), titles.ascii_title(u)) >= least}
        got = [(r.id, r.entry_id) for r in link.similar_titles(p, b, least).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_suggest_titles_cut_short(spark):
    whole = "Glacier and permafrost: a long report about the northern valleys of Dalesk and their people"
    papers = spark.createDataFrame([(1, "Glacier and permafrost", None, "x.pdf", 2000, None), (2, "Glacier", None, "y.pdf", 2000, None)], "id bigint, title string, title_from_layout string, filename string, year int, citekey string")
    bib = spark.createDataFrame([(10, "doe2000glacier", whole, "Doe, Jane", 2000)], "entry_id bigint, citekey string, title string, authors string, year int")
    text = spark.createDataFrame([(1, whole), (2, whole)], "paper_id bigint, raw_text string")
    assert [(r.id, r.entry_id, r.tier) for r in link.suggest(papers, bib, text).collect()] == [(1, 10, "title")]


def test_many_citekeys_of_one_base(spark):
    wanted = spark.range(1000).selectExpr("id", "'unknown' as base")
    taken = spark.createDataFrame([("unknown",), ("unknowna",), ("unknownb",), ("unknownaa",)], "citekey string")
    got = [r.citekey for r in link.assign_citekeys(wanted, taken).orderBy("id").collect()]
    assert len(set(got)) == 1000 and got[:2] == ["unknownc", "unknownd"] and got[-1] == "unknownalo"
    assert all(k.isalpha() and k.islower() and k.isascii() for k in got)
