from paperlake.llm.ocr import candidates, furniture, repaired
from paperlake.llm.queries import p4_paragraphs

BODY = "The debate over the harvest has rarely asked who records the orchard and the number of trees."


def test_furniture():
    lines = ["Some long title about orchards", "and their keepers: a study", "Ann Berg, Carl Dahl", "", "Text goes on here", "Berg et al.", "- 12 -", "and ends here.", "Journal of Field Methods 12 (3)", "SOME LONG TITLE ABOUT ORCHARDS    13", "xiv", "1984.", "[5]"]
    kinds, head = furniture(lines)
    assert list(head) == [0, 1, 2]
    assert [k and k[0] for k in kinds] == [None] * 5 + ["r", "p", None, "r", "r", "p", None, "p"]


def test_candidates():
    assert "debate" in candidates("dcbate") and "include" in candidates("iiiclucle") and candidates("xyz") == {}


def test_repair(spark):
    clean = "\n".join([BODY] * 40)
    noisy = "Orchard notes of the north\nAnn Berg\n\nThe dcbate over the har-\n- 3 -\nOrchard notes of\nvest has rare1y asked who re-\ncords the orchard in l984.\n\nAnother ﬁne para-\ngraph with H2O and x86."
    df = spark.createDataFrame([(n, clean, "t") for n in range(20)] + [(99, noisy, "t"), (99, noisy, "t"), (100, None, "t"), (101, "", "t")], "paper_id bigint, raw_text string, text string")
    rows = {r["id"]: r for r in repaired(df).collect()}
    cases = {(c.line_no, c.kind) for c in rows[99].cases}
    assert cases == {(4, "wrong_char"), (4, "broken_word"), (5, "page_number"), (6, "running_head"), (7, "wrong_char"), (7, "broken_word"), (8, "wrong_char"), (10, "wrong_char"), (10, "broken_word")}
    text = rows[99].text
    assert "The debate over the harvest has rarely asked who records the orchard in 1984." in text
    assert "Another fine paragraph with H2O and x86." in text
    assert not rows[0].cases and 100 not in rows
    again = repaired(df, with_text=False, longest=None, papers=spark.createDataFrame([(99, True, None)], "id bigint, is_scanned boolean, needs_ocr boolean")).collect()
    assert [{(c.line_no, c.kind) for c in r.cases} for r in again if r.id == 99] == [cases, cases]
    assert repaired(df.limit(0)).count() == 0


def test_a_word_broken_around_a_page_number(spark):
    noisy = "Orchard notes of the north\nAnn Berg\n\nThe debate over the har-\n- 3 -\nOrchard notes of\nvcst has rarely asked who records it."
    df = spark.createDataFrame([(n, "\n".join([BODY] * 40)) for n in range(20)] + [(99, noisy)], "paper_id bigint, raw_text string")
    row = next(r for r in repaired(df).collect() if r.id == 99)
    assert "over the harvest has rarely" in row.text and (7, "wrong_char") in {(c.line_no, c.kind) for c in row.cases}


def test_pair_counts_decide(spark):
    """Two candidates of equal counts: the one that the corpus writes beside the neighbour wins."""
    texts = ["we saw the bat fly over the barn and sleep by day"] * 30 + ["they wore the hat with a wide brim in the sun"] * 30
    df = spark.createDataFrame([(n, "Head of text\n\n" + t) for n, t in enumerate(texts)] + [(99, "Head of text\n\nnow the 6at fly and the lhat wide")], "paper_id bigint, raw_text string")
    row = next(r for r in repaired(df).collect() if r.id == 99)
    assert "the bat fly" in row.text


def test_empty_texts_stay(spark, tmp_path):
    rows = [(1, BODY), (2, None), (3, "")]
    spark.createDataFrame(rows, "paper_id bigint, raw_text string").write.parquet(str(tmp_path / "paper_text.parquet"))
    spark.createDataFrame([(1, None, True)], "id bigint, is_scanned boolean, needs_ocr boolean").write.parquet(str(tmp_path / "papers.parquet"))
    assert sorted((r.paper_id, r.text) for r in p4_paragraphs(spark, str(tmp_path)).collect()) == rows
