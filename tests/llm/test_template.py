from paperlake.llm.template import EVERY, Template, agreeing, deduce, lex, pieces


def names(text):
    return [t.name for t in lex(text)]


def test_lexing():
    assert names("a <A\n HREF='x'>b</a> &amp; \\emph{c} **d** snake_case C# [e](http://f)") == ["<a>", "</a>", "&amp;", "\\emph", "{", "}", "**o", "**c", "_m", "[", "]("]
    assert names("## Head\n\n- item\n\n12. next") == ["mark ##", "mark -", "mark 1."] and names("plain, words.") == []


def test_agreeing_pairs_take_turns():
    assert agreeing(lex("<i>a</i> b <i>c</i>")) == [("<i>", "</i>")]
    assert agreeing(lex("<i>a <i>b</i> c</i>")) == []


def test_classes_of_same_host_pages(spark):
    pages = [(f"word{n} <em>x{n}</em> and {{\\sc y}} \\ldots", "a.bib") for n in range(30)]
    pages += [("a <em>broken one", "a.bib"), ("p < 0.05", "a.bib")]
    pages += [(f"only ''here'' {n} <em>twice</em>", "b.bib") for n in range(2)] + [(f"''quoted'' {n}", "b.bib") for n in range(4)]
    df = spark.createDataFrame(pages + [(None, "a.bib"), ("", None)], "text string, host string")
    got = {(r.host, r["first"], r.second): (r.pages, r.agree) for r in deduce(df).collect()}
    assert got[("a.bib", "<em>", "</em>")] == (31, 30) and got[("a.bib", "\\ldots", None)] == (30, 30)
    assert ("b.bib", "<em>", "</em>") not in got and got[(EVERY, "<em>", "</em>")] == (33, 32)  # too few pages of one host
    assert got[("b.bib", "''o", "''c")] == (6, 6) and not any(k[1] == "<" and k[2] for k in got)
    assert deduce(df.limit(0)).count() == 0


def test_nesting_and_slots():
    t = Template([("<b>", "</b>"), ("<i>", "</i>"), ("&amp;", None), ("<b>", None)])
    text = "x <b>bold <i>both</i></b> &amp; <b>stray and $5"
    spans, singles, loose = t.spans(lex(text))
    assert [(text[a:b], path) for a, b, path in spans] == [("<i>both</i>", "<b> </b> > <i> </i>"), ("<b>bold <i>both</i></b>", "<b> </b>")]
    assert [x.name for x in singles] == ["&amp;", "<b>"] and [x.name for x in loose] == ["$o"]
    assert [(text[a:b], way) for a, b, way, _ in pieces(text, t)] == [("<b>bold <i>both</i></b> &amp; <b>", "class"), ("$", "slot")]


def test_one_class_of_three_tokens():
    t = Template([("\\(", "\\)"), ("\\leq", "\\)")])
    text = "so \\(p \\leq 0.05\\) holds"
    assert [text[a:b] for a, b, _, _ in pieces(text, t)] == ["\\(p \\leq 0.05\\)"]
