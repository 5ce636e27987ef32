import base64
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from paperlake.llm.bpe import DEFAULT_RANKS, Merger, decode, encode, encode_texts, read_ranks

RANKS = read_ranks(DEFAULT_RANKS)
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PARTS = ["a", "Z", "é", "ß", "中", "1", "²", "٣", " ", "  ", "\n", "\t", " ", "　", "'", "'s", "'re", "'ll", "'v", "’", "-", "!!", "😀", "́", "_", "don't", "'S", "\x1c", "​", "<|endoftext|>"]


def ours(texts):
    return [ids for ids, _ in encode_texts(texts, Merger(RANKS))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=40), min_size=1, max_size=5))
def test_equals_the_public_library(parts):
    texts = ["".join(p) for p in parts]
    assert ours(texts) == [THEIRS.encode_ordinary(t) for t in texts]


def test_long_runs_and_round_trip():
    rng = random.Random(3)
    texts = ["a" * 20_000, " " * 5_000 + "x", "".join(rng.choice(PARTS) for _ in range(30_000)), ""]
    got = ours(texts)
    assert got == [THEIRS.encode_ordinary(t) for t in texts]
    assert [decode(g, RANKS) for g in got] == texts


def test_null_and_empty(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "Hello world", 5), (3, "Hello world", 5)], "doc_id bigint, text string, ids int")
    rows = encode(df, "doc_id", "text", offsets=True).collect()
    assert sorted((r.doc_id, list(r.ids), list(r.offsets)) for r in rows) == [(1, [], []), (2, [], []), (3, [15496, 995], [0, 5]), (3, [15496, 995], [0, 5])]
    assert encode(df.limit(0), "doc_id", "text").count() == 0
