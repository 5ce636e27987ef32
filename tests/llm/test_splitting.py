from hypothesis import given, settings, strategies as st

from paperlake.llm.splitting import blocks, cuts


def brute_forced(text, limit):
    found = blocks(text)
    return {b for (a, _), (b, e) in zip(found, found[1:]) if e - a > limit} if len(text) > limit else set()


def test_blocks_and_fences():
    text = "one\ntwo\n \t\n```\na\n\nb\n```\n\nlast"
    assert [text[a:b] for a, b in blocks(text)] == ["one\ntwo", "```\na\n\nb\n```", "last"]
    assert [text[a:b] for a, b in blocks("~~~\nopen\n\nend")] == ["open\n\nend"] or blocks("~~~\nopen\n\nend")[0][0] == 0
    assert blocks("") == [] and blocks(" \n\t\n") == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["word ", "Sentence. ", "\n", "\n\n", "```\n", "x" * 30, "é, "]), max_size=60))
def test_pieces_fit_and_join(parts):
    text, limit, overlap = "".join(parts), 60, 10
    where = cuts(text, limit, overlap)
    edges = [0, *(c for c, _ in where), len(text)]
    assert edges == sorted(set(edges)) or text == ""
    assert "".join(text[a:b] for a, b in zip(edges, edges[1:])) == text
    for n, (a, b) in enumerate(zip(edges, edges[1:])):
        assert b - max(0, a - overlap * (n > 0)) <= limit
    assert brute_forced(text, limit) <= {c for c, _ in where}
