"""Sources beside Parquet: BibTeX files, note vaults, PDF folders, lists of ids and queries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

_ENTRY = re.compile(r"@(\w+)\s*\{\s*([^,\s{}]+)\s*,", re.S)
FIELDS = ("title", "author", "year", "date", "doi", "file", "abstract")


def _value(text: str, at: int) -> tuple[str, int]:
    """The field value that starts at ``at`` and where it ends."""
    while at < len(text) and text[at].isspace():
        at += 1
    if at < len(text) and text[at] in '{"':
        close, depth, i = ("}" if text[at] == "{" else '"'), 0, at + 1
        while i < len(text) and (depth or text[i] != close):
            depth += (text[i] == "{") - (text[i] == "}")
            i += 1
        return text[at + 1 : i], i + 1
    end = re.compile(r"[,}\n]").search(text, at)
    end = end.start() if end else len(text)
    return text[at:end].strip(), end


def parse_bibtex(text: str) -> list[dict]:
    """Entries with citekey, entry_type and the known fields; year from year or date."""
    out = []
    starts = [m for m in _ENTRY.finditer(text) if m.group(1).lower() not in ("comment", "string", "preamble")]
    for m, after in zip(starts, [*starts[1:], None]):
        body = text[m.end() : after.start() if after else len(text)]
        entry: dict = {"entry_type": m.group(1).lower(), "citekey": m.group(2)}
        at = 0
        while f := re.compile(r"([A-Za-z_-]+)\s*=").search(body, at):
            value, at = _value(body, f.end())
            if f.group(1).lower() in FIELDS:
                entry[f.group(1).lower()] = value
        year = re.search(r"\d{4}", entry.pop("year", "") or entry.get("date", ""))
        entry.pop("date", None)
        entry["year"] = int(year.group()) if year else None
        entry["authors"] = entry.pop("author", None)
        out.append(entry)
    return out


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """(bib_source, citekey, entry_type, title, authors, year, doi, file, abstract) of BibTeX files."""
    strings = ("bib_source", "citekey", "entry_type", "title", "authors")
    schema = pa.schema([(c, pa.string()) for c in strings] + [("year", pa.int32())] + [(c, pa.string()) for c in ("doi", "file", "abstract")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"bib_source": s.rsplit("/", 1)[-1], **e} for s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for e in parse_bibtex(t)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), "value")
    return files.mapInArrow(run, "bib_source string, citekey string, entry_type string, title string, authors string, year int, doi string, file string, abstract string")


def read_vault(spark: SparkSession, path: str) -> DataFrame:
    """(note, text) of every Markdown note under a folder."""
    notes = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return notes.select(F.input_file_name().alias("note"), F.col("value").alias("text"))


MAX_PATHS = 10_000  # changed files that are named to the reader; of more, the whole folder is read


def list_files(spark: SparkSession, path: str, pattern: str = "*.pdf", papers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((path, length, modified, hash) of the files that can be read, (path) of all files of a folder).

    With papers, only files whose path, size or time are new are read; the others keep their hash.
    """
    files = lambda where: spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").load(where)
    listed = files(path).select("path", "length", F.col("modificationTime").cast("timestamp_ntz").alias("modified"))
    hashed = lambda df: df.select("path", "length", F.col("modificationTime").cast("timestamp_ntz").alias("modified"), F.sha2("content", 256).alias("hash"))
    if papers is None:
        return hashed(files(path)), listed.select("path")
    known = papers.select("path", F.col("file_size").alias("length"), F.col("file_modified").alias("modified"), F.col("file_hash").alias("hash"))
    same = listed.join(known, ["path", "length", "modified"])
    changed = [r["path"] for r in listed.join(known, ["path", "length", "modified"], "left_anti").select("path").limit(MAX_PATHS + 1).collect()]
    if len(changed) > MAX_PATHS:
        fresh = hashed(files(path)).join(same.select("path"), "path", "left_anti")
    else:
        fresh = hashed(files(changed)) if changed else same.limit(0)
    return same.select("path", "length", "modified", "hash").unionByName(fresh), listed.select("path")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(pos, id) of the ids in a file, parted by commas or white space, once each; any other token fails the job."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", r"[,\s]+"), lambda x: x != "")).alias("pos", "token"))
    checked = F.when(F.col("token").rlike(r"^\d+$"), F.col("token").cast("bigint")).otherwise(F.raise_error(F.concat(F.lit("not an id: "), F.col("token"))).cast("bigint"))
    return lines.select("pos", checked.alias("id")).groupBy("id").agg(F.min("pos").alias("pos")).select("pos", "id").orderBy("pos")


def parse_ids(text: str) -> list[int]:
    """Ids parted by commas or white space, in order, once each; anything else is refused."""
    out: dict[int, None] = {}
    for token in re.split(r"[,\s]+", text.strip()):
        if token:
            if not re.fullmatch(r"\d+", token):
                raise ValueError(f"not an id: {token!r}")
            out.setdefault(int(token))
    return list(out)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(q_idx, q) of the non-blank lines of a file, numbered in file order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")).alias("q_idx", "q"))
    return lines.select(F.col("q_idx").cast("bigint").alias("q_idx"), F.trim("q").alias("q"))
