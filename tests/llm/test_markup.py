import pytest

from paperlake.llm.markup import Reader, clean_markup, fields, found_kinds, residue
from paperlake.llm.template import Template

CASES = [
    ("A <em>b</em> c", "A b c", {"html"}),
    ("x &amp;lt;sup&amp;gt;y&amp;lt;/sup&amp;gt; z", "x y z", {"html"}),
    ("a&nbsp b <!-- no -->c", "a  b c".replace("  ", " "), {"html"}),
    ("see [[page (topic)|this]] and ''that''", "see this and that", {"wiki"}),
    ("{{lang|la|verbum}} x", "verbum x", {"wiki"}),
    ("{{Whole Title}}", "Whole Title", {"latex"}),
    ("== Summary ==\ntext", "## Summary\ntext", {"wiki"}),
    ("caf\\'{e} {\\it it} ``q'' 40\\% x", "café it “q” 40% x", {"latex"}),
    ("from $\\alpha$-rays", "from $\\alpha$-rays", {"latex"}),
    ("CO_{2} and n^{2}", "CO_2 and n^2", {"latex"}),
    ("a **b** *c* ~~d~~ `e` [f](http://g) [h][6]", "a b c d e f h", {"markdown"}),
    ("Title\n-----\n\nText", "# Title\n\nText", {"markdown"}),
    ("R&D, AT&T; 5 * 3 * 2, n > 30, p < 0.05, A -> B, $40 or $50 million, C#, #3 [sic] a_b_c", None, set()),
    ("Smith's 'own' view", None, set()),
    ("", "", set()),
]


@pytest.mark.parametrize("text,clean,kinds", CASES)
def test_cases(text, clean, kinds):
    got, found = clean_markup(text)
    assert found == kinds
    if clean is not None:
        assert got == clean


@pytest.mark.parametrize("text,clean,kinds", CASES)
def test_cases_without_a_template(text, clean, kinds):
    """What no class explains is read as a slot, and nothing is lost."""
    got, found = Reader(Template([])).read(text)
    assert set(found) == kinds and set(found.values()) <= {"slot"}
    if clean is not None:
        assert got == clean


def test_code_is_kept_and_does_not_count():
    text = "# H\n\n```html\n<b>x</b> &amp; [[y]]\n\n```\n\n- item **bold**"
    for got, kinds in (clean_markup(text, markdown_counts=False), Reader(Template([])).read(text, markdown_counts=False)):
        assert not kinds and "```html\n<b>x</b> &amp; [[y]]\n\n```" in got and "# H" in got and "- item bold" in got


def test_table(spark):
    df = spark.createDataFrame([(1, "<i>a</i>", 0), (1, "<i>a</i>", 0), (2, None, 0), (3, "x" * 100_000 + " [[a]]", 0), (4, "", 1)], "id bigint, t string, clean int")
    rows = fields(df, "id", "t", "f")
    assert sorted(map(tuple, found_kinds(rows).collect())) == [("f", 1, "html"), ("f", 3, "wiki")]
    assert residue(rows).count() == 5 and residue(rows.limit(0)).count() == 0


def test_broadcast_and_joined_templates_agree(spark):
    texts = [(n, f"word{n} <em>x</em> and [[y (topic)|y]]" if n % 2 else f"$\\alpha$-ray {n} &nbsp; n > {n}", f"h{n % 3}") for n in range(40)] + [(99, "a <em> b", None)]
    rows = fields(spark.createDataFrame(texts, "id bigint, t string, h string"), "id", "t", "f", True, "h")
    one, other = (sorted(map(tuple, residue(rows, max_broadcast=n).collect())) for n in (10_000, 0))
    assert one == other and len(one) == 41
    by = {r[1]: (set(r[3]), set(r[4])) for r in one}
    assert by[1] == ({"html", "wiki"}, {"class"}) and by[0] == ({"html", "latex"}, {"class"}) and by[99][0] == {"html"}
