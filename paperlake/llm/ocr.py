"""Repair of text from scanned pages: page furniture, words broken at line ends, wrong characters.

Wrong characters are corrected by a noisy channel. Counts of words and of neighbouring words
come from the whole corpus. A word is suspicious if undoing one or two known character
confusions gives a much more frequent word. A line with suspicious words is decoded by
Viterbi: each word is itself or one of its candidates, scored by confusion probability times
corpus likelihood. The confusion probability of a document follows from its own obvious
errors, with a higher prior where the library says that the paper is scanned or needs OCR;
a word's count as a real word leaves out the document itself and the errors to be expected
from its candidates' counts.

Furniture is found first: page numbers, and lines with the paper's title, an author or a
journal with volume. Words broken across lines (furniture in between is skipped) are
joined, keeping a hyphen that the corpus writes.

Scale. Texts pass two map-only stages (three, if repaired texts are asked for): one counts
words and exact word pairs per batch before the shuffle, one gives the tokens of lines that
hold suspicious words, known by a bitmap of fixed size. From there on only those tokens
move: their candidates come by a join on the word, the counts of the pairs that decoding
asks for by a join on the pair, both salted. Nothing that grows with the corpus is sent to
the driver or broadcast, and there is one way for every size.

``longest`` bounds the words that are corrected (None: any length).

Defined results: null and empty texts have no case and stay null or empty; very long lines
and texts are decoded whole; repeated rows count once in p4_found; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from paperlake.functions.fold import fold
from paperlake.plans.lineage import materialize

# What is read, and what may have stood there.
CONFUSIONS = (
    ("c", "e"), ("ii", "n"), ("ii", "u"), ("cl", "d"), ("1", "l"), ("1", "i"), ("5", "s"), ("0", "o"), ("q", "g"), ("rn", "m"), ("vv", "w"), ("li", "h"), ("b", "h"), ("!", "i"), ("!", "l"), ("8", "b"), ("6", "b"), ("9", "g"),
)
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
BITS = 24  # the bitmap of suspicious words has 2**BITS bits, 2 MB
SALTS = 16
LONGEST = 64  # letters of a word that is corrected
OBVIOUS = 0.01  # count of an obvious error against its candidate's
BASE_RATE, FLOOR, EPSILON = 0.0008, 1e-4, 0.02
SCANNED_PRIOR = 0.25  # obvious errors that a paper said to be scanned is given beforehand
KINDS = ("broken_word", "wrong_char", "running_head", "page_number")

_WORD = re.compile(r"[^\W_]+(?:![^\W_]+)*")
_HYPHEN = "-‐‑­¬"
_BREAK = re.compile(rf"([^\W\d_]+)[{_HYPHEN}][^\S\n]*$")
_JOIN = re.compile(rf"(?<=[^\W\d_])[{_HYPHEN}][^\S\n]*\n[^\S\n]*(?=[^\W\d_])")
# a broken word whose next line may be furniture: it starts without a small letter or is short
_FAR = re.compile(rf"[^\W\d_][{_HYPHEN}][^\S\n]*\n(?:(?![^\S\n]*[^\W\d_A-Z])|[^\n]{{0,23}}\n)")
_NUMBER = r"(?:[\dlOIo]*\d[\dlOIo]*|[lOI]{1,3}|[ivxlc]+|[IVXLC]+)"
_PAGE = re.compile(rf"^\s*(?:[-—–]\s*{_NUMBER}\s*[-—–]|\[\s*{_NUMBER}\s*\]|(?:page|pagc|p\.|pp\.|seite|s\.)\s*{_NUMBER}(?:\s*(?:of|/|von|0f)\s*{_NUMBER})?|{_NUMBER}(?:\s*(?:of|/)\s*{_NUMBER})?)\s*$", re.I)
_SIDE_NUMBER = re.compile(rf"^\s*{_NUMBER}\s{{2,}}(?=\S)|(?<=\S)\s{{2,}}{_NUMBER}\s*$")
_JOURNAL = re.compile(r"^[^\W\d_][\w'’&., -]{5,60}?\s+[\dlOI]{1,4}\s*\([\dlOI]{1,4}\)\s*$")
_ET_AL = re.compile(r"^(\S.{0,50}?)\s+[ec]t\s+a[l1I]\.?$")
_CODE = re.compile(r"^\s*(?:```|~~~)")
_SUSPENDED = frozenset("and or und oder et ou y o to bis".split())


def _letters(text: str) -> str:
    return "".join(_WORD.findall(fold(text)))


def _near(a: str, b: str, most: int) -> bool:
    """Whether a and b differ in at most ``most`` places of a simple alignment."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > most:
        return False
    grams = {b[i : i + 3] for i in range(len(b) - 2)}
    if sum(a[i : i + 3] not in grams for i in range(len(a) - 2)) > 3 * most:
        return False  # an edit breaks at most three of them
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        if min(row) > most:
            return False
        last = row
    return last[-1] <= most


def _starts(core: str, whole: str) -> bool:
    """Whether the letters ``core`` are a beginning of ``whole``, up to misread characters."""
    if len(core) < 6 or len(core) > len(whole) + 3:
        return False
    if whole.startswith(core):
        return True
    most = max(1, len(core) // 7)
    if core[:2] != whole[:2] and core[2:4] != whole[2:4]:
        return False
    return any(_near(core, whole[: len(core) + d], most) for d in (0, -1, 1, -2, 2))


def furniture(lines: list[str]) -> tuple[list[str | None], range]:
    """(kind of furniture of each line or None, the lines of the head of the first page)."""
    kinds: list[str | None] = [None] * len(lines)
    for n, line in enumerate(lines):
        if line and len(line) < 24 and _PAGE.match(line):
            kinds[n] = "page_number"
    first = next((n for n, line in enumerate(lines) if line.strip() and kinds[n] is None and not _JOURNAL.match(_SIDE_NUMBER.sub("", line))), len(lines))
    end = first
    while end < len(lines) and end < first + 8 and lines[end].strip() and kinds[end] is None:
        end += 1
    head = [_letters(line) for line in lines[first:end]]
    # the title may be wrapped: every beginning of the head's lines
    title, people = "".join(head), "".join(head)
    code, start = False, (title[:2], title[2:4])
    for n, line in enumerate(lines):
        if line[:4].lstrip()[:3] in ("```", "~~~"):
            code = not code
        if code or kinds[n] or not line or len(line) > 110 or first <= n < end:
            continue
        core = _SIDE_NUMBER.sub("", line).strip() if "  " in line else line.strip()
        if " " not in core:
            continue
        if core[-1] == ")":
            if _JOURNAL.match(core):
                kinds[n] = "running_head"
        elif len(core) < 60 and (m := _ET_AL.match(core)):
            name = _letters(m.group(1))
            size = len(name)
            if name in people or any(
                (people[i : i + 2] == name[:2] or people[i + size - 2 : i + size] == name[-2:]) and _near(name, people[i : i + size], max(1, size // 6)) for i in range(0, max(1, len(people) - size + 1))
            ):
                kinds[n] = "running_head"
        elif core[-1] not in ".;" or core != line.strip() or core.count(" ") <= 2:
            letters = _letters(core[:12])
            if (letters[:2] == start[0] or letters[2:4] == start[1]) and _starts(_letters(core), title):
                kinds[n] = "running_head"
    return kinds, range(first, end)


def candidates(word: str) -> dict[str, tuple[int, ...]]:
    """Words that ``word`` may be a misreading of, with the one or two confusions undone."""
    spots = sorted((m.start(), k) for k, (read, _) in enumerate(CONFUSIONS) for m in re.finditer(f"(?={re.escape(read)})", word))
    out: dict[str, tuple[int, ...]] = {}
    for at, k in spots:
        read, true = CONFUSIONS[k]
        out.setdefault(word[:at] + true + word[at + len(read) :], (k,))
    for (a, j), (b, k) in combinations(spots, 2):
        if a + len(CONFUSIONS[j][0]) <= b:
            new = word[:a] + CONFUSIONS[j][1] + word[a + len(CONFUSIONS[j][0]) : b] + CONFUSIONS[k][1] + word[b + len(CONFUSIONS[k][0]) :]
            out.setdefault(new, (j, k))
    out.pop(word, None)
    return out


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _pairs(h: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words."""
    with np.errstate(over="ignore"):
        x = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        return (x ^ (x >> np.uint64(29))).astype(np.int64)


def _count(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word, n) and (pair, n): counts of words and of neighbouring words in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            counts: Counter = Counter()
            pairs = [np.empty(0, np.int64)]
            for text in batch.column(0).to_pylist():
                words = _WORD.findall(_JOIN.sub("", text).lower())
                counts.update(words)
                counts.update(_far_words(text))
                if len(words) > 1:
                    pairs.append(_pairs(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))))
            pair, n = np.unique(np.concatenate(pairs), return_counts=True)
            words = pa.array(counts, pa.string())
            yield pa.RecordBatch.from_arrays([words, pa.nulls(len(words), pa.int64()), pa.array(counts.values(), pa.int64())], names=["word", "pair", "n"])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(pair), pa.string()), pa.array(pair), pa.array(n)], names=["word", "pair", "n"])

    counted = rows.select("text").mapInArrow(run, "word string, pair bigint, n bigint")
    counted = materialize(counted.groupBy("word", "pair").agg(F.sum("n").alias("n")), "ocr-counts")
    return counted.where("word is not null").select("word", "n"), counted.where("pair is not null").select("pair", "n")


def _suspicious(words: DataFrame, longest: int | None) -> DataFrame:
    """(word, n, options array<struct<word,n,ways>>): words with more frequent candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(word) < 3 or word.isdigit():
                    continue
                for c, ways in candidates(word).items():
                    for column, value in zip(out, (word, n, c, len(ways))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), pa.string(), pa.int32()))], names=["word", "n", "option", "ways"])

    short = words if longest is None else words.where(F.length("word") <= longest)
    made = short.mapInArrow(run, "word string, n bigint, option string, ways int")
    known = words.select(F.col("word").alias("option"), F.col("n").alias("m")).where("m >= 3")
    met = made.join(known, "option").where("m >= 2 * n")
    return met.groupBy("word").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct(F.col("option").alias("word"), F.col("m").alias("n"), "ways"))).alias("options"))


def _bitmap(words: DataFrame):
    """The broadcast bitmap of the hashes of (word); 2**(BITS - 6) numbers however many there are."""
    slot = F.col("h").bitwiseAND((1 << BITS) - 1)
    hashed = words.select(F.xxhash64("word").alias("h"))
    cells = hashed.groupBy(F.shiftright(slot, 6).alias("slot")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((h & {(1 << BITS) - 1}) & 63 as int))")).alias("bits"))
    bitmap = np.zeros(1 << (BITS - 6), np.uint64)
    for at, bits in cells.collect():
        bitmap[at] = np.uint64(bits & (2**64 - 1))
    return words.sparkSession.sparkContext.broadcast(bitmap)


class _Held(dict):
    """Whether a word's hash is in the bitmap; the words are remembered."""

    def __init__(self, bitmap: np.ndarray):
        super().__init__()
        self.bitmap = bitmap

    def __missing__(self, word: str) -> bool:
        if len(self) > 500_000:
            self.clear()
        slot = xxhash.xxh64_intdigest(word, 42) & ((1 << BITS) - 1)  # the seed of the column function
        self[word] = held = bool(int(self.bitmap[slot >> 6]) >> (slot & 63) & 1)
        return held


_HAS_DIGITS = re.compile(r"[lOIo]\d|\d[lOIo]")
_ALL_DIGITS = re.compile(r"^(?=.*\d)(?=.*[lOIo])[\dlOIo]{2,}$")


def _viterbi(options: list[list[tuple[str, float]]], pair) -> list[str]:
    """The best of each place's options (word, log score) with pair(a, b) between neighbours."""
    score, back = [s for _, s in options[0]], []
    for left, right in zip(options, options[1:]):
        if len(left) == 1 and len(right) == 1:  # no choice, and the pair adds the same to every path
            back.append([0])
            score = [score[0] + right[0][1]]
            continue
        steps = [max(range(len(left)), key=lambda i: score[i] + pair(left[i][0], w)) for w, _ in right]
        score = [score[i] + pair(left[i][0], w) + s for i, (w, s) in zip(steps, right)]
        back.append(steps)
    at = max(range(len(score)), key=score.__getitem__)
    path = [at]
    for steps in reversed(back):
        at = steps[at]
        path.append(at)
    return [options[n][i][0] for n, i in enumerate(reversed(path))]


def broken_words(lines: list[str], kinds: list[str | None]) -> tuple[list[int], dict[int, tuple[str, str, int]]]:
    """(lines of running text, {line: (first part, second part, line of the second)}); furniture is skipped."""
    code, plain = False, []
    for n, line in enumerate(lines):
        if kinds[n] is None and line.strip():
            if _CODE.match(line):
                code = not code
            elif not code:
                plain.append(n)
    broken: dict[int, tuple[str, str, int]] = {}
    for n, after in zip(plain, plain[1:]):
        if lines[n].rstrip()[-1:] in _HYPHEN and (m := _BREAK.search(lines[n])):
            nxt = _WORD.match(lines[after].lstrip())
            if nxt and nxt.group()[0].isalpha() and nxt.group().lower() not in _SUSPENDED:
                broken[n] = (m.group(1), nxt.group(), after)
    return plain, broken


def _far_words(text: str) -> list[str]:
    """Words that are broken around page furniture."""
    if not _FAR.search(text):
        return []
    lines = text.split("\n")
    return [(a + b).lower() for n, (a, b, after) in broken_words(lines, furniture(lines)[0])[1].items() if after > n + 1]


class Scan:
    """What one text shows before decoding: furniture, broken words, and tokens of the lines that need them."""

    def __init__(self, text: str, held, every_broken: bool = False):
        """held[word]: whether a word may be suspicious; every_broken: tokens of lines with broken words too."""
        lines = self.lines = text.split("\n")
        kinds, _ = furniture(lines)
        self.kinds = kinds
        cases = [(n + 1, k) for n, k in enumerate(kinds) if k]
        plain, broken = broken_words(lines, kinds)
        cases += [(n + 1, "broken_word") for n in broken]
        self.broken = broken
        # tokens (line, start, end, word, may be wrong); a broken word is one token at its first line
        self.tokens: list[tuple[int, int, int, str, bool]] = []
        self.total, taken = 0, {after for _, _, after in broken.values()}
        for n in plain:
            line = lines[n]
            words = _WORD.findall(line.lower())
            self.total += len(words)
            if n in broken and words:
                words[-1] += broken[n][1].lower()
            if n in taken:
                words = words[1:]
            hot = any([held[w] for w in words]) or _HAS_DIGITS.search(line) and any(_ALL_DIGITS.match(w) for w in _WORD.findall(line))
            if hot or every_broken and n in broken:
                spans = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(line)]
                if n in taken:
                    spans = spans[1:]
                if n in broken and spans:
                    x, y, w = spans[-1]
                    spans[-1] = (x, y, w + broken[n][1])
                self.tokens += [(n, x, y, w, bool(held[w.lower()])) for x, y, w in spans]
            if not line.isascii() and any(c in LIGATURES for c in line):
                cases.append((n + 1, "wrong_char"))
        self.cases = sorted(set(cases))


def _options(tokens: list[dict], known: dict[int, tuple[int, list]], total: int, scanned: bool) -> list[tuple[list[dict], list[list[tuple[str, float]]]]]:
    """(tokens, options (word, log score) of each) of every line that has a suspicious word.

    tokens has line, at (the first character), end, word; known tells a token's number its word's count and candidates.
    """
    seen: Counter = Counter()
    obvious = 0
    for n, t in enumerate(tokens):
        low = t["word"].lower()
        seen[low] += 1
        if n in known:
            count, found = known[n]
            obvious += count <= OBVIOUS * max(o["n"] for o in found)
        elif _ALL_DIGITS.match(t["word"]):
            obvious += 1
    rate = max(FLOOR, (obvious + SCANNED_PRIOR * scanned) / (4.0 * total + 50))
    out: list[tuple[list[dict], list]] = []
    at = 0
    while at < len(tokens):
        end = at
        while end < len(tokens) and tokens[end]["line"] == tokens[at]["line"]:
            end += 1
        options, doubt = [], False
        for n in range(at, end):
            w = tokens[n]["word"]
            if n in known:
                count, found = known[n]
                expected = 4 * BASE_RATE * sum(o["n"] for o in found)
                real = max(0.0, count - seen[w.lower()] - expected) + EPSILON
                options.append([(w, math.log(real))] + [(o["word"], math.log(o["n"] * rate ** o["ways"])) for o in found])
                doubt = True
            elif _ALL_DIGITS.match(w):
                options.append([(w, math.log(EPSILON)), (w.translate(_DIGITS), 0.0)])
                doubt = True
            else:
                options.append([(w, 0.0)])
        if doubt:
            out.append((tokens[at:end], options))
        at = end
    return out


def _asked(lines, hashes: dict) -> set[int]:
    """Hashes of the word pairs that decoding the lines looks at."""
    out: set[int] = set()
    for _, options in lines:
        for left, right in zip(options, options[1:]):
            if len(left) > 1 or len(right) > 1:
                for a, _ in left:
                    for b, _ in right:
                        out.add(_pair(a, b, hashes))
    return out


def _pair(a: str, b: str, hashes: dict) -> int:
    return int(_pairs(np.array([hashes[a.lower()], hashes[b.lower()]], np.uint64))[0])


def _decode(lines, counts: dict[int, int], hashes: dict) -> list[tuple[int, int, str, int]]:
    """(line, first character, word, line of the wrong character) of every corrected word."""

    def pair(a: str, b: str) -> float:
        return 0.5 * math.log1p(counts.get(_pair(a, b, hashes), 0))

    out = []
    for here, options in lines:
        for t, new in zip(here, _viterbi(options, pair)):
            if new != t["word"]:
                at = next((i for i, (x, y) in enumerate(zip(t["word"].lower(), new)) if x != y), 0)
                second = t["after"] >= 0 and at >= t["end"] - t["at"]
                out.append((t["line"], t["at"], new, t["after"] if second else t["line"]))
    return out


_DIGITS = str.maketrans({"l": "1", "I": "1", "O": "0", "o": "0"})


def _paragraphs(lines, kinds, tokens, broken, wrong) -> str:
    """Lines joined to paragraphs, without furniture, words whole and corrected."""
    taken = {after: second for _, second, after in broken.values()}
    by_line: dict[int, list[tuple]] = {}
    for t in tokens:
        by_line.setdefault(t[0], []).append(t)
    out: list[list[str]] = [[]]
    code = False
    for n, line in enumerate(lines):
        if _CODE.match(line):
            out += [[line]] if not code else []
            if code:
                out[-1][0] += "\n" + line
                out.append([])
            code = not code
            continue
        if code:
            out[-1][0] += "\n" + line
            continue
        if kinds[n]:
            continue
        if not line.strip():
            after = next((k for k in range(n + 1, len(lines)) if lines[k].strip()), None)
            before = next((k for k in range(n - 1, -1, -1) if lines[k].strip()), None)
            split = kinds[after] if after is not None else None
            if before is not None and (split or kinds[before]) and out[-1] and not out[-1][-1].rstrip().endswith((".", "!", "?", ":")):
                continue  # a page break inside a sentence
            out.append([])
            continue
        done, at = [], 0
        if n in taken:
            at = len(line) - len(line.lstrip()) + len(taken[n])
        for _, a, b, w, _ in by_line.get(n, []):
            if a < at:
                continue
            new = wrong.get((n, a))
            done.append(line[at:a])
            if n in broken and b - a < len(w):
                new = (new.capitalize() if w[0].isupper() else new) if new else w
                done.append(new)
                at = len(line)
            else:
                done.append((new.upper() if w.isupper() and len(w) > 1 else new.capitalize() if w[0].isupper() else new) if new else w)
                at = b
        done.append(line[at:])
        body = "".join(done)
        for glyph, plain in LIGATURES.items():
            body = body.replace(glyph, plain)
        if body.strip():
            out[-1].append(body.strip())
    return "\n\n".join(" ".join(p) for p in out if p)


_TOKENS = "array<struct<line:int,at:int,end:int,word:string,held:boolean,after:int>>"
_CASES = "array<struct<line_no:int,kind:string>>"


def _scanned(rows: DataFrame, bitmap, text_too: bool) -> DataFrame:
    """(key, id, cases, total, tokens[, text]) of every text, key naming the row."""
    token = pa.struct([("line", pa.int32()), ("at", pa.int32()), ("end", pa.int32()), ("word", pa.string()), ("held", pa.bool_()), ("after", pa.int32())])
    case = pa.struct([("line_no", pa.int32()), ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = _Held(bitmap.value), TaskContext.get().partitionId() << 40
        for batch in batches:
            cases, totals, tokens = [], [], []
            for text in batch.column(1).to_pylist():
                scan = Scan(text, held)
                cases.append([{"line_no": a, "kind": k} for a, k in scan.cases])
                totals.append(scan.total)
                last: dict[int, int] = {}
                for i, t in enumerate(scan.tokens):
                    last[t[0]] = i
                tokens.append([
                    {"line": a, "at": b, "end": c, "word": w, "held": h, "after": scan.broken[a][2] if a in scan.broken and last[a] == i else -1}
                    for i, (a, b, c, w, h) in enumerate(scan.tokens)
                ])
            keys = np.arange(n, n + batch.num_rows)
            n += batch.num_rows
            columns = [pa.array(keys), batch.column(0), pa.array(cases, pa.list_(case)), pa.array(totals, pa.int64()), pa.array(tokens, pa.list_(token))]
            yield pa.RecordBatch.from_arrays(columns + [batch.column(1)] * text_too, names=["key", "id", "cases", "total", "tokens"] + ["text"] * text_too)

    schema = f"key bigint, id bigint, cases {_CASES}, total bigint, tokens {_TOKENS}" + ", text string" * text_too
    return rows.select("id", "text").mapInArrow(run, schema)


def repaired(
    df: DataFrame, id_col: str = "paper_id", text_col: str = "raw_text", with_text: bool = True, papers: DataFrame | None = None, longest: int | None = LONGEST
) -> DataFrame:
    """(id, text, cases array<struct<line_no,kind>>) of every text; text is null without with_text.

    papers (id, is_scanned, needs_ocr) tells which papers are more likely to hold errors.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null and text <> ''")
    words, pairs = _count(rows)
    table = materialize(_suspicious(words, longest), "ocr-suspicious")
    scans = materialize(_scanned(rows, _bitmap(table), with_text), "ocr-scans")

    # candidates of the tokens, by word; then the counts of the word pairs that decoding asks for
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    hot = scans.where(F.size("tokens") > 0)
    token = hot.select("key", F.posexplode("tokens").alias("n", "t")).where("t.held").select("key", "n", F.lower("t.word").alias("word"))
    token = token.withColumn("salt", F.pmod(F.hash("key"), F.lit(SALTS)))
    known = token.join(table.withColumnRenamed("n", "count").withColumn("salt", every), ["word", "salt"]).groupBy("key").agg(F.collect_list(F.struct("n", "count", "options")).alias("known"))
    doubt = hot.select("key", "id", "total", "tokens").join(known, "key", "left")
    flags = F.lit(False)
    if papers is not None:
        said = papers.where(F.coalesce("is_scanned", F.lit(False)) | F.coalesce("needs_ocr", F.lit(False))).select(F.col("id").cast("bigint").alias("id"), F.lit(True).alias("said")).distinct()
        doubt, flags = doubt.join(said, "id", "left"), F.coalesce("said", F.lit(False))
    doubt = doubt.select("key", "total", "tokens", "known", flags.alias("scanned"))

    def lines_of(row: dict) -> list:
        return _options(row["tokens"], {k["n"]: (k["count"], k["options"]) for k in row["known"] or []}, row["total"], row["scanned"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            asked = [sorted(_asked(lines_of(row), hashes)) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(asked, pa.list_(pa.int64()))], names=[*batch.schema.names, "asked"])

    option = "array<struct<word:string,n:bigint,ways:int>>"
    schema = f"key bigint, total bigint, tokens {_TOKENS}, known array<struct<n:int,count:bigint,options:{option}>>, scanned boolean"
    doubt = materialize(doubt.mapInArrow(ask, f"{schema}, asked array<bigint>"), "ocr-doubt")
    asked = doubt.select("key", F.explode("asked").alias("pair"))
    met = pairs.join(asked.select("pair").distinct(), "pair").withColumn("salt", every)
    counts = asked.withColumn("salt", F.pmod(F.hash("key"), F.lit(SALTS))).join(met, ["pair", "salt"]).groupBy("key").agg(F.collect_list(F.struct("pair", "n")).alias("counts"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        kind = pa.list_(pa.struct([("line", pa.int32()), ("at", pa.int32()), ("word", pa.string()), ("on", pa.int32())]))
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                got = _decode(lines_of(row), {c["pair"]: c["n"] for c in row["counts"] or []}, hashes)
                found.append([dict(zip(("line", "at", "word", "on"), x)) for x in got])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["key", "wrong"])

    wrong = doubt.drop("asked").join(counts, "key", "left").mapInArrow(decode, "key bigint, wrong array<struct<line:int,at:int,word:string,on:int>>")
    done = scans.drop("total", "tokens").join(wrong, "key", "left")
    more = F.transform("wrong", lambda w: F.struct((w["on"] + 1).alias("line_no"), F.lit("wrong_char").alias("kind")))
    cases = F.array_sort(F.array_union("cases", F.coalesce(more, F.array().cast(_CASES)))).alias("cases")
    if not with_text:
        return done.select("id", F.lit(None).cast("string").alias("text"), cases)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = Counter()
        for batch in batches:
            texts = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                fixed = {(w["line"], w["at"]): w["word"] for w in found or []}
                lines = {n for n, _ in fixed}
                scan = Scan(text, nothing, every_broken=True)
                have = {t[0] for t in scan.tokens}
                tokens = scan.tokens + [t for n in lines - have for t in _line_tokens(scan, n)]
                texts.append(_paragraphs(scan.lines, scan.kinds, sorted(tokens), scan.broken, fixed))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(3)], names=["id", "text", "cases"])

    return done.select("id", "text", "wrong", cases).mapInArrow(render, f"id bigint, text string, cases {_CASES}")


def _line_tokens(scan: Scan, n: int) -> list[tuple[int, int, int, str, bool]]:
    """The tokens of a line without a broken word at its end."""
    spans = [(n, m.start(), m.end(), m.group(), False) for m in _WORD.finditer(scan.lines[n])]
    return spans[1:] if any(after == n for _, _, after in scan.broken.values()) else spans
