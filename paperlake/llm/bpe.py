"""Encoding of a corpus with a public byte-level BPE vocabulary.

Pre-tokenisation runs without a regular expression. Every code point is looked up in an
array of classes; class and look-ahead give one of ten symbols, and each symbol is a
transition function on eight states. Composition of such functions is associative, so the
states of a whole batch come from a scan: blocks of symbols are composed side by side, the
blocks' functions are scanned by doubling, and a replay from the known states marks where
tokens start. The slices between starts go through pair merging, cached by slice.

Defined results: null and empty texts have the empty list of ids; special tokens never
occur, their strings are ordinary text; repeated rows are encoded as often as they occur;
other columns are ignored; lone surrogates are encoded as U+FFFD.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHE_SLICES = 500_000  # slices whose ids a worker keeps; beyond it the cache starts anew
BATCH_CHARS = 1 << 20

# symbols: a last space before ink, another last white space, white space before more of it,
# letter, number, other, apostrophe alone, before one or two letters of a contraction, reset
SPACE, LAST, RUN, LETTER, NUMBER, OTHER, APOS, APOS1, APOS2, RESET = range(10)
# states: between tokens, after a leading space, in letters, numbers, others, white space, one or two letters to go
DONE, LEAD, IN_L, IN_N, IN_O, IN_W, GO1, GO2 = range(8)
BLOCK = 64


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, does a token start) by symbol * 8 + state."""
    step, start = np.zeros((10, 8), np.uint8), np.ones((10, 8), np.uint8)
    for sym, to in ((SPACE, LEAD), (LAST, DONE), (RUN, IN_W), (LETTER, IN_L), (NUMBER, IN_N), (OTHER, IN_O), (APOS, IN_O), (APOS1, GO1), (APOS2, GO2), (RESET, DONE)):
        step[sym] = to
    start[RUN, IN_W] = 0
    for sym, own in ((LETTER, IN_L), (NUMBER, IN_N), (OTHER, IN_O), (APOS, IN_O), (APOS1, IN_O), (APOS2, IN_O)):
        start[sym, [own, LEAD]] = 0
    step[[APOS1, APOS2], IN_O] = step[[APOS1, APOS2], LEAD] = IN_O
    step[LETTER, GO1], step[LETTER, GO2] = DONE, GO1
    start[LETTER, [GO1, GO2]] = 0
    return step.ravel(), start.ravel()


STEP, START = _tables()


@cache
def _classes() -> np.ndarray:
    """Of every code point: 0 other, 1 letter, 2 number, 3 white space."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            out[c] = 1
        elif k == "N":
            out[c] = 2
    # The code points with the White_Space property.
    out[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 3
    return out


def symbols(points: np.ndarray, resets: np.ndarray) -> np.ndarray:
    """The symbol of every code point; ``resets`` are the places between texts."""
    kind = _classes()[points]
    kind[resets] = 9
    after = np.append(kind[1:], 9)
    sym = np.array([OTHER, LETTER, NUMBER, RUN, 0, 0, 0, 0, 0, RESET], np.uint8)[kind]
    last = (kind == 3) & (after < 3)
    sym[last] = LAST
    sym[last & (points == 32)] = SPACE
    at = np.flatnonzero((points == 39) & (kind == 0))
    if len(at):
        padded = np.concatenate([np.where(kind == 9, 0, points), np.zeros(2, points.dtype)])
        one, two = padded[at + 1], padded[at + 2]
        two = np.where(one == 0, 0, two)
        e, l = ord("e"), ord("l")
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == e) | (one == l) & (two == l)
        sym[at] = np.where(np.isin(one, [ord(c) for c in "stmd"]), APOS1, np.where(pair, APOS2, APOS))
    return sym


def starts(sym: np.ndarray) -> np.ndarray:
    """The places where a token starts, by a scan of transition functions."""
    n = len(sym)
    if n == 0:
        return np.empty(0, np.int64)
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, RESET, np.uint8)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T).astype(np.int16) * 8
    func = np.tile(np.arange(8, dtype=np.int16), (rows, 1))
    for column in grid:
        func = STEP.take(column[:, None] + func).astype(np.int16)
    gap = 1
    while gap < rows:  # inclusive scan: func[r] after func[r - gap]
        func[gap:] = np.take_along_axis(func[gap:], func[:-gap].astype(np.intp), 1)
        gap *= 2
    state = np.zeros(rows, np.int16)
    state[1:] = func[:-1, DONE]
    begin = np.empty((BLOCK, rows), np.uint8)
    for c, column in enumerate(grid):
        at = column + state
        begin[c] = START.take(at)
        state = STEP.take(at).astype(np.int16)
    return np.flatnonzero(begin.T.ravel()[:n])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Merger(dict):
    """Slice to ids, filled by pair merging."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = merge(piece.encode("utf-8", "replace") if piece.isascii() else piece.encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode(), self.ranks)
        if len(piece) <= 64:
            if len(self) >= CACHE_SLICES:
                self.clear()
            self[piece] = ids
        return ids


def merge(data: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one slice: always the pair of lowest rank, the leftmost first; n log n."""
    if (whole := ranks.get(data)) is not None:
        return (whole,)
    n = len(data)
    end = list(range(1, n + 1))  # of the part that starts here
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        mid = end[i]
        if mid <= 0 or mid >= n or end[mid] != e:
            continue  # one of the two parts is no more
        end[i], end[mid] = e, 0
        if e < n:
            before[e] = i
            if (r := ranks.get(data[i : end[e]])) is not None:
                heapq.heappush(heap, (r, i, end[e]))
        if (p := before[i]) >= 0 and (r := ranks.get(data[p:e])) is not None:
            heapq.heappush(heap, (r, p, e))
    out, i = [], 0
    while i < n:
        out.append(ranks[data[i : end[i]]])
        i = end[i]
    return tuple(out)


def encode_texts(texts: list[str], merger: Merger) -> Iterator[tuple[list[int], list[int]]]:
    """(ids, character offset of the slice of each id) of every text."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < BATCH_CHARS):
            size += len(texts[j]) + 1
            j += 1
        joined = "\n".join(texts[i:j]) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(t) for t in texts[i:j]], np.int64)
        ends = np.cumsum(lengths + 1) - 1
        begin = starts(symbols(points, ends))
        bounds = np.searchsorted(begin, ends).tolist()
        begin, base, lo = begin.tolist(), 0, 0
        for end, hi in zip(ends.tolist(), bounds):
            ids: list[int] = []
            offsets: list[int] = []
            places = begin[lo:hi]
            for a, b in zip(places, [*places[1:], end]):
                got = merger[joined[a:b]]
                ids += got
                offsets += [a - base] * len(got)
            yield ids, offsets
            base, lo = end + 1, hi + 1  # the reset is a start of its own
        i = j


def decode(ids: list[int], ranks: dict[bytes, int]) -> str:
    back = {v: k for k, v in ranks.items()}
    return b"".join(back[i] for i in ids).decode("utf-8", "replace")


def encode(df: DataFrame, id_col: str, text_col: str, ranks_path: str = DEFAULT_RANKS, offsets: bool = False) -> DataFrame:
    """(id_col, ids[, offsets]) of every row. The vocabulary, of fixed size, is read once and broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids, places, at = [], [], [0]
            for got, where in encode_texts(texts, merger):
                ids += got
                if offsets:
                    places += where
                at.append(len(ids))
            cut = pa.array(at, pa.int32())
            columns = [batch.column(0), pa.ListArray.from_arrays(cut, pa.array(ids, pa.int32()))]
            if offsets:
                columns.append(pa.ListArray.from_arrays(cut, pa.array(places, pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "offsets"][: len(columns)])

    schema = "id bigint, ids array<int>" + ", offsets array<int>" * offsets
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
