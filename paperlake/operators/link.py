"""Bibliography links: keys, file names and titles against papers; citekeys; what is missing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from paperlake.functions import latex, packed, titles
from paperlake.functions.names import given_name_first, surnames
from paperlake.functions.titles import normal_doi
from paperlake.operators.metadata import HEAD_CHARS, containment, head_words, share_held, title_words
from paperlake.operators.repairs import author_list
from paperlake.operators.works import display_title, has_ink
from paperlake.plans.lineage import materialize

SIMILAR, CERTAIN = 0.85, 0.95
TIERS = ("strong", "title", "weak", "filename")
CUT_SHORT = 12  # least characters of a title that counts as the start of a longer one
BLOCK = 2_000  # titles of a side, over all lengths, that are compared in one group
HELD_PAPERS, HELD_ENTRIES = 16_384, 4_096  # papers and entries that meet in one group by the words that texts hold
PAIRS, LANES, LONG = 50_000, 4_096, 256  # pairs gathered, pairs aligned at a time; titles that are longer are aligned one by one
# Words a citekey skips, characters BibTeX escapes.
KEY_STOPWORDS = ("a", "an", "the", "of", "in", "on", "for", "and", "to")
_ESCAPES = (("\\", r"\\textbackslash{}"), ("&", r"\\&"), ("%", r"\\%"), ("#", r"\\#"), ("_", r"\\_"))


def bib_file(column: str = "file") -> Column:
    """Base name of a file field, plain or ":path:TYPE"."""
    path = F.regexp_replace(F.regexp_replace(F.col(column), r"^:", ""), r":[A-Za-z]+$", "")
    return F.element_at(F.split(path, "[/\\\\\\\\]"), -1)


def by_doi(papers: DataFrame, bib: DataFrame) -> DataFrame:
    """(id, entry_id): equal normalized DOI; of several entries the last."""
    entries = bib.where(has_ink("doi")).groupBy(normal_doi(F.col("doi")).alias("key")).agg(F.max("entry_id").alias("entry_id"))
    return papers.where(has_ink("doi")).select("id", normal_doi(F.col("doi")).alias("key")).join(entries, "key").select("id", "entry_id")


def by_file(papers: DataFrame, bib: DataFrame) -> DataFrame:
    """(id, entry_id): equal file name, case-blind; of several entries the last."""
    entries = bib.where(has_ink("file")).groupBy(F.lower(bib_file()).alias("key")).agg(F.max("entry_id").alias("entry_id"))
    return papers.select("id", F.lower("filename").alias("key")).join(entries, "key").select("id", "entry_id")


@pandas_udf(T.StringType())
def bib_title(column: pd.Series) -> pd.Series:
    return column.map(lambda t: titles.ascii_title(latex.plain(t)) if t else "")


_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def _common(a: str, places: dict[str, int]) -> int:
    """Length of the longest common subsequence of a and the text whose letters' places are bits."""
    rest = whole = (1 << places[""]) - 1
    for c in a:
        hit = rest & places.get(c, 0)
        rest = (rest + hit | rest - hit) & whole
    return places[""] - rest.bit_count()


def _places(text: str) -> dict[str, int]:
    out = {"": len(text)}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _close(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(title, bib_title, ratio) of all distinct titles of that ratio or more.

    Nothing is lost: of the pairs whose lengths allow the ratio, only those are left out whose
    letters, or whose longest common subsequence, are too few for it.
    """
    left, right = materialize(left.select("title").distinct(), "titles-left"), materialize(right.select("bib_title").distinct(), "titles-right")
    step = math.log((2 - threshold) / threshold) * (1 + 1e-6)  # lengths of similar titles are one such step apart at most
    rows, columns = (max(1, -(-t.count() // BLOCK)) for t in (left, right))
    size = lambda c: F.floor(F.log(F.length(c).cast("double")) / step)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    p = left.withColumn("s", size("title")).withColumn("i", part("title", rows)).withColumn("j", every(columns))
    b = right.withColumn("s", F.explode(F.array(*(size("bib_title") + d for d in (-1, 0, 1))))).withColumn("j", part("bib_title", columns)).withColumn("i", every(rows))

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        ts, us = x["title"].tolist(), y["bib_title"].tolist()
        out: list[tuple[str, str, float]] = []
        if ts and us:
            letters = np.array([[u.count(c) for c in _LETTERS] for u in us], dtype=np.int16)
            sizes, places = letters.sum(1), [_places(u) for u in us]
            for t in ts:
                most = np.minimum(letters, np.array([t.count(c) for c in _LETTERS], dtype=np.int16)).sum(1)
                for k in np.flatnonzero(2.0 * most / (len(t) + sizes) >= threshold):
                    if 2.0 * _common(t, places[k]) / (len(t) + len(us[k])) >= threshold and (ratio := titles.similarity(t, us[k])) >= threshold:
                        out.append((t, us[k], ratio))
        return pd.DataFrame(out, columns=["title", "bib_title", "ratio"])

    return p.groupBy("s", "i", "j").cogroup(b.groupBy("s", "i", "j")).applyInPandas(compare, "title string, bib_title string, ratio double")


def _titled(papers: DataFrame, bib: DataFrame) -> tuple[DataFrame, DataFrame]:
    p = papers.select("id", "year", (~has_ink("title")).alias("guess"), bib_title(display_title()).alias("title")).where("title <> ''")
    b = bib.select("entry_id", F.col("year").alias("bib_year"), bib_title("title").alias("bib_title")).where("bib_title <> ''")
    return p, b


def similar_titles(papers: DataFrame, bib: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """(id, entry_id, ratio, guess, year, bib_year) of similar titles; guess: only printed on the paper.

    Complete: equal to comparing every paper with every entry.
    """
    p, b = _titled(papers, bib)
    met = _close(p, b, threshold).join(p, "title").join(b, "bib_title")
    return met.select("id", "entry_id", "ratio", "guess", "year", "bib_year").distinct()


def _counts(texts: list[str]) -> np.ndarray:
    return np.array([[t.count(c) for c in _LETTERS] for t in texts], dtype=np.int16).reshape(len(texts), len(_LETTERS))


_CODE = np.full(128, len(_LETTERS), np.int64)  # for any other sign a number that matches none
_CODE[[ord(c) for c in _LETTERS]] = np.arange(len(_LETTERS))


def _signs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which text, number of the letter, place) of every letter of plain titles."""
    sizes = np.array([len(t) for t in texts], np.int64)
    of = np.repeat(np.arange(len(texts)), sizes)
    sign = _CODE[np.frombuffer("".join(texts).encode("ascii", "replace"), np.uint8)]
    return of, sign, np.arange(len(of)) - (np.cumsum(sizes) - sizes)[of]


def _commons(ts: list[str], us: list[str], j: np.ndarray, k: np.ndarray) -> np.ndarray:
    """``_common`` of many pairs (ts[j], us[k]) at once; a title's letters are bits of 64-bit words."""
    lengths, out = np.array([len(t) for t in ts]), np.zeros(len(j), np.int64)
    last = len(_LETTERS)
    for width in range(1, LONG // 64 + 1):
        pairs = np.flatnonzero((lengths[j] + 63) // 64 == width)
        if not len(pairs):
            continue
        t_of, t_at = np.unique(j[pairs], return_inverse=True)
        u_of, u_at = np.unique(k[pairs], return_inverse=True)
        of, sign, at = _signs([ts[t] for t in t_of])
        places = np.zeros((width, last + 1, len(t_of)), np.uint64)
        np.bitwise_or.at(places, (at // 64, sign, of), np.uint64(1) << (at % 64).astype(np.uint64))
        places[:, last] = 0
        of, sign, at = _signs([us[u] for u in u_of])
        long = np.bincount(of, minlength=len(u_of))
        signs = np.full((long.max(), len(u_of)), last, np.int64)
        signs[at, of] = sign
        signs *= len(t_of)  # rows of places as they lie in memory
        places, size = places.reshape(width, -1), lengths[t_of]
        whole = np.array([[(1 << int(min(max(n - 64 * w, 0), 64))) - 1 for n in size] for w in range(width)], np.uint64)
        order = np.argsort(long[u_at], kind="stable")
        for at in range(0, len(order), LANES):
            some = order[at : at + LANES]
            t, u = t_at[some], u_at[some]
            rest = np.full((width, len(some)), np.uint64(2**64 - 1))
            for row in signs[: long[u].max()]:
                of, carry = row[u] + t, None
                for w in range(width):
                    hit = rest[w] & places[w].take(of)
                    total = rest[w] + hit
                    if w + 1 < width:
                        over = total < hit
                    if carry is not None:
                        total += carry
                        if w + 1 < width:
                            over |= total < carry
                    if w + 1 < width:
                        carry = over.astype(np.uint64)
                    rest[w] = total | (rest[w] ^ hit)
            out[pairs[some]] = size[t] - np.bitwise_count(rest & whole[:, t]).sum(0)
    kept: dict[int, dict[str, int]] = {}
    for n in np.flatnonzero(lengths[j] > LONG):
        t = int(j[n])
        kept[t] = kept.get(t) or _places(ts[t])
        out[n] = _common(us[k[n]], kept[t])
    return out


def _at_least(words: list[np.ndarray], bits: np.ndarray, need: int) -> np.ndarray:
    """The bits that are set in at least ``need`` of the rows, which are added with carries."""
    count: list[np.ndarray] = []
    for row in words:
        carry = bits[row]
        for n, digit in enumerate(count):
            count[n], carry = digit ^ carry, digit & carry
        if len(count) < (len(words)).bit_length():
            count.append(carry)
    same, more = np.full(bits.shape[1], np.uint64(2**64 - 1)), np.zeros(bits.shape[1], np.uint64)
    for n in reversed(range(max(len(count), need.bit_length()))):
        digit = count[n] if n < len(count) else np.zeros_like(more)
        more, same = (more, same & digit) if need >> n & 1 else (more | same & digit, same & ~digit)
    return more | same


def held_pairs(x: pd.DataFrame, y: pd.DataFrame, similar: float, contained: float) -> pd.DataFrame:
    """(id, entry_id) of papers (id, title, words) and entries (entry_id, bib_title, words) of similar titles.

    Left out are only pairs where the paper's words hold less than the share ``contained`` of the entry's.
    """
    ts, us, n = x["title"].tolist(), y["bib_title"].tolist(), len(x)
    j_found, k_found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if n and len(y):
        wanted = [np.asarray(w, np.int64) for w in y["words"]]
        known = np.unique(np.concatenate(wanted))
        bits = np.zeros((len(known), -(-n // 64) * 8), np.uint8)
        there = [np.asarray(w, np.int64) for w in x["words"]]
        flat, row = np.concatenate(there), np.repeat(np.arange(n), [len(w) for w in there])
        mine = np.isin(flat, known)
        flat, row = flat[mine], row[mine]
        np.bitwise_or.at(bits, (np.searchsorted(known, flat), row >> 3), (1 << (row & 7)).astype(np.uint8))
        lanes, t_counts, u_counts = bits.view(np.uint64), _counts(ts), _counts(us)
        t_sizes, u_sizes = np.array([len(t) for t in ts]), np.array([len(u) for u in us])
        js: list[np.ndarray] = []
        ks: list[np.ndarray] = []

        def align() -> None:
            j, k = np.concatenate(js), np.concatenate(ks)
            good = 2.0 * _commons(ts, us, j, k) / (t_sizes[j] + u_sizes[k]) >= similar
            j, k = j[good], k[good]
            ratio: dict[tuple[str, str], float] = {}
            for p in {(ts[a], us[b]) for a, b in zip(j, k)}:
                ratio[p] = titles.similarity(*p)
            good = np.array([ratio[ts[a], us[b]] >= similar for a, b in zip(j, k)], bool)
            j_found.append(j[good])
            k_found.append(k[good])
            js.clear()
            ks.clear()

        for k, w in enumerate(wanted):
            need = max(0, math.ceil((contained - 0.001) * len(w)))  # shares are rounded to three digits
            if not len(w) and contained > 0:
                continue
            passed = _at_least(list(np.searchsorted(known, w)), lanes, need) if need else None
            j = np.arange(n) if passed is None else np.flatnonzero(np.unpackbits(passed.view(np.uint8), bitorder="little")[:n])
            j = j[2.0 * np.minimum(t_counts[j], u_counts[k]).sum(1) / (t_sizes[j] + u_sizes[k]) >= similar]
            if len(j):
                js.append(j)
                ks.append(np.full(len(j), k))
                if sum(map(len, js)) >= PAIRS:
                    align()
        if js:
            align()
    j, k = np.concatenate(j_found), np.concatenate(k_found)
    return pd.DataFrame({"id": x["id"].to_numpy()[j], "entry_id": y["entry_id"].to_numpy()[k]})


def similar_held(papers: DataFrame, bib: DataFrame, heads: DataFrame, similar: float, contained: float) -> DataFrame:
    """(id, entry_id) of similar titles where the head of the paper's text (id, raw_text) holds that share of the entry's title words.

    Complete: what is left out has less than that share. Words are compared by their hashes, so a
    pair more may come out.
    """
    p, b = _titled(papers, bib)
    entries = bib.select("entry_id", title_words(F.col("title")).alias("w")).join(b.select("entry_id", "bib_title"), "entry_id")
    entries = materialize(entries, "entries-held")
    words = entries.select(F.explode("w").alias("w")).distinct()
    texts = papers.select("id").join(heads, "id")
    own = texts.select("id", F.explode(F.array_distinct(head_words("raw_text"))).alias("w")).join(words, "w").groupBy("id").agg(F.collect_set(F.xxhash64("w")).alias("words"))
    # papers without any of the words stay: nothing may be asked of them
    p = materialize(p.select("id", "title").join(texts.select("id").distinct(), "id").join(own, "id", "left").select("id", "title", F.coalesce("words", F.array().cast("array<bigint>")).alias("words")), "papers-held")
    b = entries.select("entry_id", "bib_title", F.transform(F.coalesce("w", F.array().cast("array<string>")), lambda w: F.xxhash64(w)).alias("words"))
    rows, columns = (max(1, -(-t.count() // most)) for t, most in ((p, HELD_PAPERS), (entries, HELD_ENTRIES)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    p, b = p.withColumn("i", part("id", rows)).withColumn("j", every(columns)), b.withColumn("j", part("entry_id", columns)).withColumn("i", every(rows))
    compare = lambda x, y: held_pairs(x, y, similar, contained)
    return p.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInPandas(compare, "id bigint, entry_id bigint").distinct()


def cut_titles(papers: DataFrame, bib: DataFrame) -> DataFrame:
    """(id, entry_id): the paper's title is the start of the entry's title."""
    p, b = _titled(papers, bib)
    start = lambda c: F.substring(c, 1, CUT_SHORT).alias("start")
    p = p.where(F.length("title") >= CUT_SHORT).select("id", "title", start("title"))
    b = b.where(F.length("bib_title") >= CUT_SHORT).select("entry_id", "bib_title", start("bib_title"))
    return p.join(b, "start").where(F.startswith("bib_title", "title")).select("id", "entry_id").distinct()


def by_title(papers: DataFrame, bib: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """(id, entry_id, ratio, confidence): the most similar bib title of each paper."""
    scored = similar_titles(papers, bib, threshold)
    best = Window.partitionBy("id").orderBy(F.desc("ratio"), "entry_id")
    top = scored.withColumn("r", F.row_number().over(best)).where("r = 1")
    sure = F.when(F.col("guess"), "uncertain").when((F.col("ratio") >= CERTAIN) | F.coalesce(F.col("year") == F.col("bib_year"), F.lit(False)), "certain").otherwise("likely")
    return top.select("id", "entry_id", F.round("ratio", 6).alias("ratio"), sure.alias("confidence"))


def reconcile(papers: DataFrame, bib: DataFrame, with_titles: bool = True) -> DataFrame:
    """(id, entry_id, phase): one paper per entry and one entry per paper; DOI, file name, title in turn."""
    phases = [("doi", by_doi), ("file", by_file)] + ([("title", lambda p, b: by_title(p, b))] if with_titles else [])
    done = None
    for name, match in phases:
        p, b = papers, bib
        if done is not None:
            p, b = p.join(done, "id", "left_anti"), b.join(done, "entry_id", "left_anti")
        first = match(p, b).select("id", "entry_id")
        first = first.groupBy("entry_id").agg(F.min("id").alias("id")).groupBy("id").agg(F.min("entry_id").alias("entry_id"))
        new = first.select("id", "entry_id", F.lit(name).alias("phase"))
        done = new if done is None else done.unionByName(new)
    return done


def missing(bib: DataFrame, papers: DataFrame) -> DataFrame:
    """Entries that no paper has by citekey, file name or DOI: three anti joins in a row."""
    left = bib.join(papers.where(has_ink("citekey")).select(F.lower("citekey").alias("k")), F.lower(bib.citekey) == F.col("k"), "left_anti")
    left = left.withColumn("_f", F.lower(bib_file())).join(papers.select(F.lower("filename").alias("_f")), "_f", "left_anti")
    dois = papers.where(has_ink("doi")).select(normal_doi(F.col("doi")).alias("_d"))
    return left.withColumn("_d", F.when(has_ink("doi"), normal_doi(F.col("doi")))).join(dois, "_d", "left_anti").select("entry_id", "citekey")


def citekey_base(surname: Column, year: Column, title: Column) -> Column:
    """surname + year + first telling word of the title, "unknown" if all are missing."""
    word = F.get(F.filter(F.regexp_extract_all(F.lower(title), F.lit("([a-z]+)"), F.lit(1)), lambda w: ~w.isin(list(KEY_STOPWORDS))), F.lit(0))
    key = F.concat(F.coalesce(F.regexp_replace(F.lower(surname), "[^a-z]", ""), F.lit("")), F.coalesce(year.cast("string"), F.lit("")), F.coalesce(word, F.lit("")))
    return F.when(key == "", "unknown").otherwise(key)


def suffix(n: Column) -> Column:
    """"" for 0, then a, b, … z, aa, ab, … zz, aaa, …: up to 7 letters, more than an int counts"""
    letters = []
    for _ in range(7):
        letters.insert(0, F.when(n > 0, F.chr(((n - 1) % 26 + 97).cast("int"))).otherwise(""))
        n = F.floor((n - 1) / 26)
    return F.concat(*letters)


def assign_citekeys(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """(id, citekey) from (id, base): the base, or with the next free letter; case-blind against taken."""
    used = taken.select(F.lower("citekey").alias("k")).where("k is not null").distinct()
    base = wanted.withColumn("low", F.lower("base"))
    bases = base.groupBy("low").agg(F.count("*").alias("n"))
    # each taken key without its last letters, 0 to 7 of them: the bases that it may take a place of
    tail = F.least(F.lit(7), F.length(F.regexp_extract("k", "[a-z]*$", 0)))
    starts = used.select(F.explode(F.transform(F.sequence(F.lit(0), tail), lambda i: F.substring(F.col("k"), F.lit(1), F.length("k") - i))).alias("_x"))
    slots = bases.join(starts.groupBy("_x").agg(F.count("*").alias("u")), F.col("low") == F.col("_x"), "left")
    slots = slots.select("low", F.explode(F.sequence(F.lit(0), (F.col("n") + F.coalesce("u", F.lit(0)) + 1).cast("int"))).alias("s"))
    free = slots.withColumn("k", F.concat("low", suffix(F.col("s")))).join(used, "k", "left_anti")
    free = free.withColumn("place", F.row_number().over(Window.partitionBy("low").orderBy("s")))
    asked = base.withColumn("place", F.row_number().over(Window.partitionBy("low").orderBy("id")))
    return asked.join(free.select("low", "place", "s"), ["low", "place"]).select("id", F.concat("base", suffix(F.col("s"))).alias("citekey"))


def bib_entries(papers: DataFrame, prefix: str = "") -> DataFrame:
    """(id, entry): BibTeX text; article if there is a DOI, else misc."""

    def esc(c: Column) -> Column:
        for what, by in _ESCAPES:
            c = F.regexp_replace(c, "\\\\" if what == "\\" else what, by)
        return c

    field = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"  {name} = {{"), c, F.lit("}")))
    people = F.array_join(author_list(F.col("authors")), " and ")
    body = F.concat_ws(
        ",\n", field("title", esc(F.col("title"))), field("author", esc(people)), field("year", F.col("year").cast("string")),
        field("doi", F.col("doi")), field("file", F.concat(F.lit(prefix), F.col("filename"))),
    )
    kind = F.when(has_ink("doi"), "article").otherwise("misc")
    return papers.where(has_ink("citekey")).select("id", F.concat(F.lit("@"), kind, F.lit("{"), F.col("citekey"), F.lit(",\n"), body, F.lit("\n}\n")).alias("entry"))


def append_entries(papers: DataFrame, bib: DataFrame, ids: DataFrame, prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """((id, entry) blocks to append to a .bib file, papers with the keys assigned) for the given papers without a citekey.

    A new key is free among the keys of papers and of the file.
    """
    open_papers = papers.where(~has_ink("citekey")).join(ids.select("id").distinct(), "id", "left_semi")
    surname = F.get(surnames_column(F.get(author_list(F.col("authors")), F.lit(0))), F.lit(0))
    wanted = open_papers.select("id", citekey_base(surname, F.col("year"), display_title()).alias("base"))
    taken = papers.where(has_ink("citekey")).select("citekey").union(bib.where(has_ink("citekey")).select("citekey"))
    keys = assign_citekeys(wanted, taken).withColumnRenamed("citekey", "_key")
    keyed = papers.join(materialize(keys, "citekeys"), "id", "left")
    out = keyed.select(*(F.coalesce("_key", c).alias(c) if c == "citekey" else F.col(c) for c in papers.columns))
    return bib_entries(out.join(ids.select("id").distinct(), "id", "left_semi").join(open_papers.select("id"), "id", "left_semi"), prefix), out


def apply_matches(papers: DataFrame, matches: DataFrame, bib: DataFrame, include_uncertain: bool = False, force: bool = False) -> DataFrame:
    """Papers with the citekeys of matches (id, entry_id[, confidence]); a key that is there stays unless forced."""
    sure = matches if include_uncertain or "confidence" not in matches.columns else matches.where("confidence <> 'uncertain'")
    keys = sure.join(bib.select("entry_id", F.col("citekey").alias("_key")), "entry_id").groupBy("id").agg(F.min("_key").alias("_key"))
    new = F.coalesce("_key", "citekey") if force else F.coalesce("citekey", "_key")
    return papers.join(keys, "id", "left").select(*(new.alias(c) if c == "citekey" else F.col(c) for c in papers.columns))


def suggest(papers: DataFrame, bib: DataFrame, paper_text: DataFrame, similar: float = 0.75, contained: float = 0.6, file_contained: float = 0.8) -> DataFrame:
    """(id, entry_id, citekey, tier, alternates, ambiguous, owner_id): citekeys for papers without one.

    Title evidence: a similar title, or one that starts with the paper's, whose words the text
    holds. File evidence: surname and year in the file name, and the title or its words in the
    text's opening. tier: strong (both), title, weak (a printed title of low confidence, where
    the table tells it) or filename. ambiguous: other entries pass too. owner_id is the paper
    that already has the key.
    """
    open_papers = papers.where(~has_ink("citekey"))
    text = paper_text.select(F.col("paper_id").alias("id"), F.substring("raw_text", 1, HEAD_CHARS).alias("raw_text"))  # what is asked of it lies there
    titled = similar_held(open_papers, bib, text, similar, contained).union(cut_titles(open_papers, bib)).select("id", "entry_id", F.lit(1).alias("by_title"), F.lit(0).alias("by_file"))
    surname = F.lower(F.regexp_extract("filename", r"^([A-Za-z]+)[-_ ]?\d{4}", 1))
    year = F.regexp_extract("filename", r"^[A-Za-z]+[-_ ]?(\d{4})", 1)
    files = open_papers.select("id", surname.alias("k"), year.alias("y")).where("k <> ''")
    entries = bib.where("year is not null").select("entry_id", F.explode(surnames_column("authors")).alias("k"), F.col("year").cast("string").alias("y"))
    filed = files.join(entries.distinct(), ["k", "y"]).select("id", "entry_id", F.lit(0).alias("by_title"), F.lit(1).alias("by_file"))
    met = materialize(titled.union(filed).groupBy("id", "entry_id").agg(F.max("by_title").alias("t"), F.max("by_file").alias("f")), "suggest-met")
    known = bib.select("entry_id", "citekey", title_words(F.col("title")).alias("words"), bib_title("title").alias("phrase"))
    head = F.concat(F.lit(" "), F.regexp_replace(F.lower("raw_text"), "[^a-z0-9]+", " "), F.lit(" "))
    # words and head of a text are made once, where texts are parted by paper, not for every entry it meets
    opening = text.join(met.select("id").distinct(), "id", "left_semi").repartition("id").select("id", F.array_distinct(head_words("raw_text")).alias("there"), head.alias("head"))
    scored = met.join(known, "entry_id").join(opening, "id").withColumn("held", share_held("words", "there"))
    whole = (F.length("phrase") >= 8) & F.col("head").contains(F.concat(F.lit(" "), F.col("phrase"), F.lit(" ")))
    t, f = (F.col("t") == 1) & (F.col("held") >= contained), (F.col("f") == 1) & ((F.col("held") >= file_contained) | whole)
    low = F.lit(False)
    if "title_layout_confidence" in papers.columns:
        scored = scored.join(papers.select("id", F.coalesce(F.col("title_layout_confidence") != "high", F.lit(True)).alias("low")), "id")
        low = F.col("low")
    ranked = scored.withColumn("tier", F.when(t & f, "strong").when(t & low, "weak").when(t, "title").when(f, "filename")).where("tier is not null")
    order = F.array_position(F.array(*(F.lit(x) for x in TIERS)), F.col("tier"))
    best = ranked.groupBy("id").agg(F.min_by(F.struct("entry_id", "citekey", "tier"), F.struct(order, -F.col("held"), "entry_id")).alias("b"), (F.count("*") - 1).alias("alternates")).select("id", "b.*", "alternates")
    owners = papers.where(has_ink("citekey")).groupBy(F.lower("citekey").alias("low_key")).agg(F.min("id").alias("owner_id"))
    return best.join(owners, F.lower("citekey") == F.col("low_key"), "left").select("id", "entry_id", "citekey", "tier", "alternates", (F.col("alternates") > 0).alias("ambiguous"), "owner_id")


def apply_suggestions(papers: DataFrame, suggestions: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(papers with the keys applied, (id, citekey, outcome applied, refused or no_suggestion)) for asked ids (pos, id).

    A key that another paper has, or an earlier id of this call takes, is refused.
    """
    told = asked.groupBy("id").agg(F.min("pos").alias("pos")).join(suggestions.select("id", "citekey", "owner_id"), "id", "left")
    first = told.where("citekey is not null and owner_id is null").groupBy(F.lower("citekey").alias("low")).agg(F.min_by("id", "pos").alias("taker"))
    told = told.join(first, F.lower("citekey") == F.col("low"), "left")
    outcome = F.when(F.col("citekey").isNull(), "no_suggestion").when(F.col("owner_id").isNull() & (F.col("taker") == F.col("id")), "applied").otherwise("refused")
    report = materialize(told.select("id", "citekey", outcome.alias("outcome")), "suggested")
    keys = report.where("outcome = 'applied'").select("id", F.col("citekey").alias("_key"))
    out = papers.join(keys, "id", "left").select(*(F.coalesce("_key", c).alias(c) if c == "citekey" else F.col(c) for c in papers.columns))
    return out, report


def clear_audited(papers: DataFrame, audited: DataFrame, asked: DataFrame, log_path: str, at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(papers without the citekeys of asked ids that the audit flags, asked ids it doesn't flag).

    What is removed is first appended to the log as JSON lines.
    """
    chosen = audited.join(asked.select("id").distinct(), "id", "left_semi").join(papers.select("id", "filename", "citekey"), "id")
    chosen = materialize(chosen.withColumn("at", F.current_timestamp() if at is None else at), "audited")
    chosen.write.mode("append").json(log_path)
    gone = chosen.select("id", F.lit(True).alias("_gone"))
    out = papers.join(gone, "id", "left").select(*(F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == "citekey" else F.col(c) for c in papers.columns))
    return out, asked.select("id").distinct().join(audited, "id", "left_anti")


@pandas_udf(T.ArrayType(T.StringType()))
def surnames_column(column: pd.Series) -> pd.Series:
    return column.map(surnames)


@pandas_udf(T.ArrayType(T.StringType()))
def entry_authors(column: pd.Series) -> pd.Series:
    """Names of a packed author field, given name first, without markup."""
    return column.map(lambda a: [given_name_first(latex.plain(n)) for n in packed.extract(a, packed.resolve(packed.skeleton(a)))] if a else [])


PULLED = ("title", "authors", "year", "doi", "abstract")


def pull(papers: DataFrame, bib: DataFrame, paper_text: DataFrame, threshold: float = 0.6, source: str = "bib") -> DataFrame:
    """(id, action, changed, old, new): what taking metadata from the linked entry would do.

    action is not_in_bib, manual, unverified (the text lacks the entry's title), no_change or
    pull; changed lists the fields whose value would differ, old and new map them to their
    values. Of several entries with the paper's key the one of the smallest id counts. A stored
    DOI that the text prints wins over an entry's that it doesn't. Fields the tables lack are
    left out.
    """
    fields = [f for f in PULLED if f in papers.columns and f in bib.columns]
    packed_entry = F.struct("entry_id", *(F.col(f).alias(f"b_{f}") for f in fields))
    entries = bib.where(has_ink("citekey")).groupBy(F.lower("citekey").alias("key")).agg(F.min_by(packed_entry, "entry_id").alias("e")).select("key", "e.*")
    linked = papers.where(has_ink("citekey")).withColumn("key", F.lower("citekey")).join(entries, "key", "left")
    linked = linked.join(paper_text.select(F.col("paper_id").alias("id"), "raw_text"), "id", "left")
    head = F.lower(F.substring("raw_text", 1, 6000))
    old = {f: F.col(f).cast("string") for f in fields}
    new = {f: F.col(f"b_{f}").cast("string") for f in fields}
    differs = {f: F.coalesce(new[f] != "", F.lit(False)) & ~new[f].eqNullSafe(old[f]) for f in fields}
    if "authors" in fields:
        linked = linked.withColumn("old_names", entry_authors("authors")).withColumn("new_names", entry_authors("b_authors"))
        old["authors"], new["authors"] = F.to_json("old_names"), F.to_json("new_names")
        differs["authors"] = (F.size("new_names") > 0) & ~F.col("new_names").eqNullSafe(F.col("old_names"))
    if "doi" in fields:
        stored, told = F.when(has_ink("doi"), normal_doi(F.col("doi"))), normal_doi(F.col("b_doi"))
        printed = F.coalesce(F.contains(head, F.lower("doi")) & ~F.contains(head, told), F.lit(False))
        new["doi"] = told
        differs["doi"] = has_ink("b_doi") & ~told.eqNullSafe(stored) & ~(stored.isNotNull() & printed)
    changed = F.concat_ws(",", *(F.when(differs[f], F.lit(f)) for f in fields))
    values = lambda of: F.map_from_arrays(F.array_compact(F.array(*(F.when(differs[f], F.lit(f)) for f in fields))), F.filter(F.array(*(F.when(differs[f], F.coalesce(of[f], F.lit(""))) for f in fields)), lambda x: x.isNotNull()))
    manual = F.coalesce(F.col("metadata_source").ilike("%manual%") & ~F.col("metadata_source").ilike("bib:%"), F.lit(False))
    action = (
        F.when(F.col("entry_id").isNull(), "not_in_bib").when(manual, "manual").when(containment("b_title", "raw_text") < threshold, "unverified")
        .when(changed == "", "no_change").otherwise("pull")
    )
    out = linked.withColumn("action", action)
    pulled = F.col("action") == "pull"
    return out.select("id", "action", F.when(pulled, changed).otherwise("").alias("changed"), F.when(pulled, values(old)).alias("old"), F.when(pulled, values(new)).alias("new"))


def newly_titled(pulled: DataFrame) -> DataFrame:
    """(id) of papers that a pull gives a title they lacked: their chunks want embedding anew."""
    return pulled.where("action = 'pull' and map_contains_key(new, 'title')").where(F.trim(F.col("old")["title"]) == "").select("id")
