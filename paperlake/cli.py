"""A command line over ``api.Library``: python -m paperlake.cli ROOT COMMAND …

Rows go out as JSON lines, tab-separated lines or ids. Exit codes: 0 found, 1 refused (a JSON
object with the refusal's code goes to stderr), 2 nothing found, 3 found in part, 64 wrong usage.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperlake.api import Library
from paperlake.operators.ledger import LedgerError
from paperlake.sources import readers, sinks

OK, REFUSED, NOTHING, PART, USAGE = 0, 1, 2, 3, 64


class _Parser(argparse.ArgumentParser):
    def error(self, message: str) -> None:
        self.print_usage(sys.stderr)
        self.exit(USAGE, f"{self.prog}: {message}\n")


def _show(df: DataFrame, form: str, out=None) -> int:
    """Print the rows; NOTHING if there is none."""
    out = out or sys.stdout
    if form == "ids":
        name = next((c for c in ("id", "doc_id", "paper_id") if c in df.columns), df.columns[0])
        df = df.select(F.col(name).cast("string").alias("value"))
    else:
        df = sinks.as_json(df) if form == "json" else sinks.as_lines(df.select(*(F.col(f"`{n}`") if t not in ("array", "map", "struct") else F.to_json(n).alias(n) for n, t in ((f.name, f.dataType.typeName()) for f in df.schema.fields))))
    n = 0
    for row in df.toLocalIterator():
        print(row["value"], file=out)
        n += 1
    return OK if n else NOTHING


def _parser() -> argparse.ArgumentParser:
    p = _Parser(prog="paperlake")
    p.add_argument("root")
    p.add_argument("--format", choices=("json", "text", "ids"), default="text")
    p.add_argument("--ledgers")
    sub = p.add_subparsers(dest="command", required=True, parser_class=_Parser)

    def command(name: str, *options: tuple) -> None:
        c = sub.add_parser(name)
        for flags, more in options:
            c.add_argument(*flags.split(), **more)

    limit, ids, by = ("-n --limit", {"type": int, "default": 20}), ("--ids", {"required": True}), ("--by", {"required": True})
    for name in ("status", "pending", "errors", "completeness", "schema", "works", "verify", "audit", "missing", "pull", "match"):
        command(name)
    command("search", ("query", {}), limit, ("--syntax", {"action": "store_true"}), ("--works", {"action": "store_true"}), ("--restrict-to-ids", {}))
    command("find", ("fragment", {}), limit)
    command("grep", ("needle", {}), ("-i --ignore-case", {"action": "store_true"}), ("-n --limit", {"type": int, "default": 50}), ("--ids", {}))
    command("info", ids, ("--query", {}))
    command("read", ids)
    command("queue", ("--needs", {"action": "append", "default": []}), ("--has", {"action": "append", "default": []}), ("--is", {"action": "append", "default": [], "dest": "is_"}), ("--count", {"action": "store_true"}), ("--limit", {"type": int}))
    command("gaps", ("--field", {"required": True}), ("--attempted-only", {"action": "store_true"}))
    command("suggest")
    command("collections")
    command("collection-create", ("name", {}), by, ("--note", {}))
    command("collection-add", ("name", {}), ids, by, ("--why", {}))
    command("collection-remove", ("name", {}), ids, by)
    command("collection-show", ("name", {}))
    command("collection-rename", ("name", {}), ("new", {}), by)
    command("collection-delete", ("name", {}), by)
    command("collection-undo", ("batch", {}), by)
    command("collection-history", ("--name", {}), ("--limit", {"type": int, "default": 50}))
    command("inbox-add", ids, by, ("--why", {}), ("--source", {"default": "manual"}), ("--page", {"type": int}), ("--quote", {}), ("--note", {}))
    command("inbox-list", ("--status", {"default": "active"}))
    command("inbox-due", ("--limit", {"type": int}))
    command("inbox-review", ("item", {"type": int}), ("verdict", {}), by)
    command("inbox-undo", ("batch", {}), by)
    command("inbox-history", ("--limit", {"type": int, "default": 50}))
    return p


def _run(lib: Library, a: argparse.Namespace) -> int:
    show: Callable[[DataFrame], int] = lambda df: _show(df, a.format)
    some = lambda text: None if text is None else lib.ids(*readers.parse_ids(text))
    c, box = lib.collections, lib.inbox
    plain = {"status": lib.status, "pending": lib.pending, "errors": lib.errors, "completeness": lib.completeness, "schema": lib.schema, "works": lib.works, "verify": lib.verify, "audit": lib.audit, "missing": lib.missing, "pull": lib.pull, "match": lib.match_bib, "suggest": lib.suggest}
    if a.command in plain:
        return show(plain[a.command]())
    if a.command == "search":
        restrict = some(a.restrict_to_ids)
        return show(lib.search(a.query, a.limit, None if restrict is None else restrict.withColumnRenamed("id", "doc_id"), syntax=a.syntax, fold_works=a.works).results)
    if a.command == "find":
        return show(lib.find(a.fragment, a.limit))
    if a.command == "grep":
        hits, more, missing = lib.grep(a.needle, a.ignore_case, a.limit, some(a.ids))
        code = show(hits)
        return PART if code == OK and (more or missing is not None and missing.first() is not None) else code
    if a.command in ("info", "read"):
        got = lib.info(some(a.ids), a.query) if a.command == "info" else lib.read(some(a.ids))
        have = got.where("found" if a.command == "info" else "format is not null").count()
        show(got)
        return NOTHING if not have else OK if have == got.count() else PART
    if a.command == "queue":
        filters = {k: tuple(v) for k, v in (("needs", a.needs), ("has", a.has), ("is_", a.is_)) if v}
        if a.count:
            print(lib.queue_count(**filters))
            return OK
        return show(lib.queue(a.limit, **filters))
    if a.command == "gaps":
        return show(lib.gaps(a.field, a.attempted_only))
    if a.command == "collections":
        return show(c.list(lib.papers))
    if a.command == "collection-show":
        return show(c.resolve(a.name, lib.papers))
    if a.command == "collection-history":
        return show(c.history(a.limit, a.name))
    if a.command == "inbox-list":
        return show(box.items(lib.papers, a.status))
    if a.command == "inbox-due":
        return show(box.due(lib.papers, a.limit))
    if a.command == "inbox-history":
        return show(box.history(a.limit))
    passage = None if getattr(a, "page", None) is None else {"page": a.page, "quote": a.quote, "note": a.note}
    write = {
        "collection-create": lambda: (c.create(a.name, a.by, a.note), None), "collection-add": lambda: c.add(a.name, some(a.ids), lib.papers, a.by, a.why),
        "collection-remove": lambda: c.remove(a.name, some(a.ids), lib.papers, a.by), "collection-rename": lambda: (c.rename(a.name, a.new, a.by), None),
        "collection-delete": lambda: (c.delete(a.name, a.by), None), "collection-undo": lambda: c.undo(a.batch, a.by),
        "inbox-add": lambda: box.enqueue(some(a.ids), lib.papers, a.by, a.why, a.source, passage), "inbox-review": lambda: (box.review(a.item, a.verdict, a.by), None),
        "inbox-undo": lambda: box.undo(a.batch, a.by),
    }
    batch, report = write[a.command]()
    print(json.dumps({"batch_id": batch}))
    if report is None:
        return OK
    show(report)
    failed = report.where("outcome in ('not_found', 'ambiguous')") if "outcome" in report.columns else report
    return PART if failed.first() is not None else OK


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("paperlake").getOrCreate()
    try:
        return _run(Library(spark, a.root, ledgers=a.ledgers), a)
    except LedgerError as e:
        print(json.dumps({"error": e.code, "message": str(e)}), file=sys.stderr)
        return REFUSED
    except ValueError as e:
        print(json.dumps({"error": getattr(e, "code", "invalid_argument"), "message": str(e)}), file=sys.stderr)
        return USAGE


if __name__ == "__main__":
    sys.exit(main())
