"""Evaluation passages inside a training corpus, by winnowed word fingerprints.

Texts are reduced to folded words. Of every ``window`` neighbouring k-gram hashes the least
(the last of equal ones) is kept, on both sides, so two texts that share ``k + window - 1``
words share a kept fingerprint at the same place of the shared words. The corpus's
fingerprints pass a bitmap of the test fingerprints before any shuffle; the survivors join
the test side, and each hit is extended to both sides until a letter differs.

Line-end hyphens are ambiguous (a broken word or a compound). A second bitmap of the test
side's words and neighbouring words tells which reading can match; where both can, the
text is fingerprinted in both readings. Hits are extended over letters, where the readings
are the same.

Defined results: null, empty and short texts have no case; a pair comes out once however
often it is hit or its rows are repeated; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from paperlake.functions.fold import fold
from paperlake.plans.lineage import materialize

SHARED, K = 12, 6  # words that make a case; words of a fingerprint
BITS = 24  # the bitmap of test fingerprints has 2**BITS bits, 2 MB
MAX_BROADCAST = 200_000  # test fingerprints, about 200 bytes each with their words
SALTS = 16
CACHE = 500_000
TOGETHER = 100_000  # words whose fingerprints are worked out together

_EMPHASIS = re.compile(r"</?(?:em|strong|b|i|u|mark|del|span)\b[^<>]{0,200}>|[*_~`]+|[­​-‍⁠﻿]")
_BROKEN = re.compile(r"(?<=[^\W_])[-‐‑¬][^\S\n]*\n\s*(?=[^\W_])")
_WORD = re.compile(r"[^\W_]+(?:\x01[^\W_]+)*")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def readings(text: str | None, known=None) -> list[list[str]]:
    """The words of a text in one or two readings of its line-end hyphens.

    known tells whether a word or "two words" occurs on the test side; without it the
    readings are all hyphens joined and all parted.
    """
    if not text:
        return []
    soft = _BROKEN.sub("\x01", _EMPHASIS.sub("", text.replace("\r", "").replace("\x01", " ")))
    words = _WORD.findall(fold(soft))
    if "\x01" not in soft:
        return [words]
    joined: list[str] = []
    parted: list[str] = []
    for word in words:
        if "\x01" not in word:
            joined.append(word)
            parted.append(word)
            continue
        parts, whole = word.split("\x01"), word.replace("\x01", "")
        can_join, can_part = known is None or known(whole), known is None or all(known(f"{x} {y}") for x, y in zip(parts, parts[1:]))
        joined += [whole] if can_join or not can_part else parts
        parted += parts if can_part or not can_join else [whole]
    return [joined] if joined == parted else [joined, parted]


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def fingerprints(words: list[str], hashes: dict, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the winnowed k-grams; texts of at least k words have one."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = np.fromiter((hashes[w] for w in words), np.uint64, len(words))
    grams = _grams(h, k)
    w = min(window, n)
    m = n - w + 1
    least, place = grams[:m].copy(), np.arange(m)
    for j in range(1, w):
        g = grams[j : j + m]
        later = g <= least
        least[later] = g[later]
        place[later] += j - (place[later] - np.flatnonzero(later))
    place = np.unique(place)
    return place, grams[place]


def fingerprints_of(texts: list[list[str]], hashes: dict, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, place, hash) of the fingerprints of several texts, worked out together."""
    short = [n for n, words in enumerate(texts) if len(words) < k + window - 1]
    long = [n for n, words in enumerate(texts) if len(words) >= k + window - 1]
    parts = []
    for n in short:
        place, fp = fingerprints(texts[n], hashes, k, window)
        parts.append((np.full(len(place), n), place, fp))
    if long:
        sizes = np.array([len(texts[n]) for n in long])
        h = np.fromiter((hashes[w] for n in long for w in texts[n]), np.uint64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(long)), sizes)
        start = np.cumsum(sizes) - sizes
        grams = _grams(h, k)
        m = len(grams) - window + 1
        least, place = grams[:m].copy(), np.arange(m)
        for j in range(1, window):
            g = grams[j : j + m]
            later = np.flatnonzero(g <= least)
            least[later] = g[later]
            place[later] = later + j
        place = np.unique(place[owner[:m] == owner[k + window - 2 : k + window - 2 + m]])
        parts.append((np.array(long)[owner[place]], place - start[owner[place]], grams[place]))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    n = len(h) - k + 1
    grams = np.zeros(n, np.uint64)
    for j in range(k):
        grams = grams * _MIX + h[j : j + n]
    grams = (grams ^ (grams >> np.uint64(29))) * _MIX
    return grams ^ (grams >> np.uint64(32))


def shared_words(doc: list[str], at: int, item: list[str], item_at: int) -> int:
    """Whole words of the item in the run of equal letters around a hit."""
    d, i = "".join(doc), "".join(item)
    d0, i0 = sum(map(len, doc[:at])), sum(map(len, item[:item_at]))
    left = 0
    while left < min(d0, i0) and d[d0 - left - 1] == i[i0 - left - 1]:
        left += 1
    right, most = 0, min(len(d) - d0, len(i) - i0)
    while right < most and d[d0 + right] == i[i0 + right]:
        right += 1
    edges = set(np.cumsum([0, *map(len, doc)]).tolist())
    marks = [x for x in np.cumsum([0, *map(len, item)]).tolist() if i0 - left <= x <= i0 + right]
    good = [n for n, x in enumerate(marks) if x - i0 + d0 in edges]
    return good[-1] - good[0] if good else 0


def _in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h & np.uint64((1 << BITS) - 1)
    return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _bitmap(hashes: DataFrame):
    """The broadcast bitmap of a column of hashes; 2**(BITS - 6) words however many there are."""
    slot = F.col("fp").bitwiseAND((1 << BITS) - 1)
    words = hashes.groupBy(F.shiftright(slot, 6).alias("slot")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((fp & {(1 << BITS) - 1}) & 63 as int))")).alias("bits"))
    bitmap = np.zeros(1 << (BITS - 6), np.uint64)
    for at, bits in words.collect():
        bitmap[at] = np.uint64(bits & (2**64 - 1))
    return hashes.sparkSession.sparkContext.broadcast(bitmap)


def _vocabulary(items: DataFrame, text_col: str) -> DataFrame:
    """(fp): hashes of the words and of two neighbouring words of the test side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[int] = set()
            for text in batch.column(0).to_pylist():
                for words in readings(text):
                    found |= {xxhash.xxh64_intdigest(w) for w in words} | {xxhash.xxh64_intdigest(f"{x} {y}") for x, y in zip(words, words[1:])}
            yield pa.RecordBatch.from_arrays([pa.array(np.fromiter(found, np.uint64, len(found)).astype(np.int64))], names=["fp"])

    return items.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(run, "fp bigint")


def _side(df: DataFrame, id_col: str, text_col: str, k: int, window: int, reach: int, bitmap=None, vocabulary=None) -> DataFrame:
    """(id, fp, at, words): kept fingerprints with the words around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        bits = None if bitmap is None else bitmap.value
        known = None if vocabulary is None else lambda w: bool(_in(vocabulary.value, np.uint64(hashes[w])))
        for batch in batches:
            ids, fps, ats, around = [], [], [], []
            owners, texts, size = [], [], 0
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for n, (i, text) in enumerate(rows):
                for words in readings(text, known):
                    owners.append(i)
                    texts.append(words)
                    size += len(words)
                if size < TOGETHER and n + 1 < len(rows):
                    continue
                own, place, fp = fingerprints_of(texts, hashes, k, window)
                if bits is not None and len(fp):
                    there = _in(bits, fp)
                    own, place, fp = own[there], place[there], fp[there]
                for o, p, f in zip(own.tolist(), place.tolist(), fp.astype(np.int64).tolist()):
                    a = max(0, p - reach)
                    ids.append(owners[o])
                    fps.append(f)
                    ats.append(p - a)
                    around.append(" ".join(texts[o][a : p + k + reach]))
                owners, texts, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps, pa.int64()), pa.array(ats, pa.int32()), pa.array(around, pa.string())], names=["id", "fp", "at", "words"])

    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null and id is not null")
    return rows.mapInArrow(run, "id bigint, fp bigint, at int, words string")


def leaks(
    corpus: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", shared: int = SHARED, k: int = K
) -> DataFrame:
    """(doc_id, item_id): the document holds ``shared`` consecutive words of the item."""
    window, reach = shared - k + 1, shared - 1
    tests = materialize(_side(items, item_id, text, k, window, reach).distinct(), "leak-tests")
    bitmap, vocabulary = _bitmap(tests.select("fp")), _bitmap(_vocabulary(items, text))
    hits = _side(corpus, doc_id, text, k, window, reach, bitmap, vocabulary)
    tests = tests.select(F.col("id").alias("item"), "fp", F.col("at").alias("item_at"), F.col("words").alias("item_words"))
    if tests.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        joined = hits.join(F.broadcast(tests), "fp")
    else:
        tests = tests.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = hits.withColumn("salt", F.pmod(F.hash("id"), F.lit(SALTS))).join(tests, ["fp", "salt"])

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            out = []
            for i, at, words, item, item_at, item_words in batch.itertuples(index=False):
                if (i, item) in seen:
                    continue
                if shared_words(words.split(" "), at, item_words.split(" "), item_at) >= shared:
                    out.append((i, item))
                    if len(seen) >= CACHE:
                        seen.clear()
                    seen.add((i, item))
            yield pd.DataFrame(out, columns=["doc_id", "item_id"], dtype="int64")

    found = joined.select("id", "at", "words", "item", "item_at", "item_words").mapInPandas(extend, "doc_id bigint, item_id bigint")
    return found.distinct()
