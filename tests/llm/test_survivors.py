import datetime as dt

from hypothesis import given, strategies as st

from paperlake.llm.survivors import layers, surviving_works, survivors

SCHEMA = "id bigint, file_hash string, doi string, title string, title_from_layout string, year int, page_count int, metadata_suspect boolean, citekey string, metadata_source string, has_text boolean, indexed_at timestamp_ntz, filename string, authors string, work_id int"


def row(i, h="h", **c):
    d = {"doi": None, "title": None, "layout": None, "year": None, "pages": None, "suspect": False, "key": None, "source": None, "text": True, "at": dt.datetime(2020, 1, 1), "authors": None} | c
    return (i, h, d["doi"], d["title"], d["layout"], d["year"], d["pages"], d["suspect"], d["key"], d["source"], d["text"], d["at"], f"f{i}.pdf", d["authors"], 0)


@given(st.lists(st.tuples(*[st.integers(0, 2)] * 3), max_size=12))
def test_layers(points):
    got = layers(points)
    for i, p in enumerate(points):
        over = [got[j] for j, q in enumerate(points) if q != p and all(a <= b for a, b in zip(q, p))]
        assert got[i] == 1 + max(over, default=0)


def test_choice_and_filling(spark):
    rows = [
        row(1, title="T", year=2001, source="openalex", key=" "),
        row(2, key="k2", source="bib:x", at=dt.datetime(2019, 1, 1)),
        row(3, key="k3", source="bib:x", authors="A", at=dt.datetime(2021, 1, 1)),
        row(4, key="k4", source="Manual", suspect=True, doi="10.1/wrong", at=None),
        row(4, key="k4", source="Manual", suspect=True, doi="10.1/wrong", at=None),
        row(9, h="alone"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.work_id: r for r in surviving_works(df).collect()}
    assert set(got) == {1}
    r = got[1]
    assert (r.canonical_id, r.copies, r.citekey, r.title, r.year, r.doi) == (4, 4, "k4", "T", "2001", "10.1/wrong")
    assert r.authors == "A" and list(r.sources)[2] == 1
    assert surviving_works(df.limit(0)).count() == 0


def test_newest_then_smallest_id(spark):
    df = spark.createDataFrame([row(5), row(6, at=dt.datetime(2022, 1, 1)), row(7, at=dt.datetime(2022, 1, 1)), row(8, at=None)], SCHEMA)
    members = spark.createDataFrame([(i, 5) for i in (5, 6, 7, 8)], "id bigint, work_id bigint")
    assert [r.canonical_id for r in survivors(df, members).collect()] == [6]
