"""Author lists, timestamps and records in their stored forms: conversions, repairs, displays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paperlake.operators.works import has_ink

LEGACY = "none:legacy"
FILE_NAME = r"^([A-Za-z]+)((?:-[A-Za-z]+)*)[-_](\d{4})[-_]"


def _texts(c: Column) -> Column:
    """Trimmed, without what is blank."""
    return F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "")


def author_list(authors: Column) -> Column:
    """Names of a JSON list or a list parted by semicolons; any other text is one name, null stays null.

    Commas are ambiguous ("Last, First"), so they part nothing.
    """
    text = F.trim(authors)
    listed = F.when(text.startswith("["), F.from_json(text, "array<string>"))
    return F.when(authors.isNull(), F.lit(None)).otherwise(F.coalesce(_texts(listed), _texts(F.split(text, ";"))))


def parsed_authors(authors: Column) -> Column:
    """Names for showing: a JSON list or text, whose parts are split at semicolons and at " and " too; empty for null."""
    text = F.trim(authors)
    listed = F.coalesce(F.when(text.startswith("["), F.from_json(text, "array<string>")), F.array(F.when(text.startswith('"'), F.coalesce(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")[0], text)).otherwise(text)))
    return F.coalesce(_texts(F.flatten(F.transform(listed, lambda x: F.split(x, r";|\s+and\s+")))), F.array().cast("array<string>"))


def iso_timestamp(value: Column) -> Column:
    """"YYYY-MM-DD HH:MM:SS" (UTC) as ISO 8601; anything else unchanged."""
    plain = r"^(\d{4}-\d{2}-\d{2}) (\d{2}:\d{2}:\d{2}(?:\.\d+)?)$"
    return F.when(value.rlike(plain), F.regexp_replace(value, plain, "$1T$2+00:00")).otherwise(value)


def cased_doi(doi: Column) -> Column:
    """A DOI without its resolver or "doi:", in its own case."""
    text = F.trim(doi)
    start = F.instr(F.lower(text), "10.")
    lead = F.lower(F.substring(text, F.lit(1), start - 1))
    known = (lead == "") | lead.isin("http://doi.org/", "https://doi.org/", "http://dx.doi.org/", "https://dx.doi.org/") | lead.rlike(r"^doi:\s*$")
    return F.when((start > 0) & known, F.substring(text, start, F.length(text))).otherwise(text)


def file_name_parts(filename: Column) -> tuple[Column, Column]:
    """(surname, year) of "surname_2001_…" or "surname-coauthor-et-al-2001-…"; null where the name is of neither form."""
    surname, year = F.lower(F.regexp_extract(filename, FILE_NAME, 1)), F.regexp_extract(filename, FILE_NAME, 3)
    return F.when(surname != "", surname), F.when(year != "", year).cast("int")


def rebuilt_abstract(inverted: Column) -> Column:
    """The text of an inverted index map<word, array<position>>; null for null or empty."""
    words = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.when(F.size(inverted) > 0, F.array_join(F.transform(F.array_sort(words), lambda x: x["w"]), " "))


def from_dump(works: DataFrame) -> DataFrame:
    """Provider records (title, authors, year, doi, abstract, source_id) from a dump of nested works.

    Columns that the dump lacks are null. authorships: array of structs with author.display_name;
    abstract_inverted_index: map of positions.
    """
    have = set(works.columns)
    pick = lambda *names: F.coalesce(*(F.col(n) for n in names if n in have), F.lit(None))
    people = F.filter(F.transform("authorships", lambda a: a["author"]["display_name"]), lambda x: x.isNotNull()) if "authorships" in have else F.lit(None).cast("array<string>")
    text = rebuilt_abstract(F.col("abstract_inverted_index")) if "abstract_inverted_index" in have else F.lit(None).cast("string")
    return works.select(
        pick("title", "display_name").alias("title"), F.to_json(people).alias("authors"), pick("publication_year", "year").cast("int").alias("year"),
        cased_doi(pick("doi").cast("string")).alias("doi"), text.alias("abstract"), pick("id", "paperId").cast("string").alias("source_id"),
    )


def repaired(papers: DataFrame, timestamps: tuple[str, ...] = (), all_orphans: bool = False) -> tuple[DataFrame, DataFrame]:
    """(papers with repaired records, (id, repair) of what changed). Doing it again changes nothing.

    Author texts become JSON lists; timestamps of text columns become ISO; abstracts left behind
    by a cleared wrong match go (all abstracts without a title if ``all_orphans``); rows that were
    enriched without a source or title are marked as misses. Steps whose columns the table lacks
    are left out.
    """
    have = set(papers.columns)
    as_list = F.from_json(F.trim("authors"), "array<string>")
    loose = F.col("authors").isNotNull() & (~F.trim("authors").startswith("[") | as_list.isNull())
    changes: dict[str, tuple[Column, dict[str, Column]]] = {"authors": (loose, {"authors": F.to_json(author_list(F.col("authors")))})}
    for c in timestamps:
        if c in have:
            changes[c] = (F.coalesce(iso_timestamp(F.col(c)) != F.col(c), F.lit(False)), {c: iso_timestamp(F.col(c))})
    if "abstract" in have:
        orphan = has_ink("abstract") & F.col("title").isNull()
        suspect = F.coalesce(F.col("metadata_suspect"), F.lit(False))
        changes["orphan_abstract"] = (orphan if all_orphans else orphan & suspect, {"abstract": F.lit(None).cast("string")})
    if "metadata_enriched_at" in have:
        miss = F.col("metadata_source").isNull() & F.col("metadata_enriched_at").isNotNull() & (F.coalesce("title", F.lit("")) == "")
        changes["legacy_miss"] = (miss, {"metadata_source": F.lit(LEGACY)})
    out = papers.select(*(_changed(c, changes) for c in papers.columns))
    told = F.array_compact(F.array(*(F.when(when, F.lit(name)) for name, (when, _) in changes.items())))
    return out, papers.select("id", F.explode(told).alias("repair"))


def _changed(column: str, changes: dict) -> Column:
    out = F.col(column)
    for when, values in changes.values():
        if column in values:
            out = F.when(when, values[column]).otherwise(out)
    return out.alias(column)


# --- display ---------------------------------------------------------------------------


def shown_size(n: Column) -> Column:
    """Bytes as "512 B", "1.5 KB", "2.0 MB", …"""
    steps = ((2**40, "TB"), (2**30, "GB"), (2**20, "MB"), (2**10, "KB"))
    out = F.concat(n.cast("bigint").cast("string"), F.lit(" B"))
    for size, unit in reversed(steps):
        out = F.when(n >= size, F.concat(F.format_string("%.1f", n / size), F.lit(f" {unit}"))).otherwise(out)
    return out


def shown_duration(seconds: Column) -> Column:
    """Seconds as "42s", "3m 5s" or "2h 10m"."""
    s = seconds.cast("bigint")
    part = lambda n, unit: F.concat(n.cast("bigint").cast("string"), F.lit(unit))
    return F.when(s < 60, part(s, "s")).when(s < 3600, F.concat_ws(" ", part(F.floor(s / 60), "m"), part(s % 60, "s"))).otherwise(F.concat_ws(" ", part(F.floor(s / 3600), "h"), part(F.floor(s % 3600 / 60), "m")))


def shown_share(part: Column, whole: Column) -> Column:
    return F.concat(F.format_string("%.1f", F.when(whole > 0, 100.0 * part / whole).otherwise(0.0)), F.lit("%"))
