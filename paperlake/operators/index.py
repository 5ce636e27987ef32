"""The keyword index: postings, document lengths and term counts in a catalog, searched without the texts.

``postings`` is ordered by term and document, so a query reads the row groups of its terms
only; a term that every document holds is split over files like any other. ``documents``
holds each document's distinct terms with their counts, for many queries at once. A rebuild
or refresh writes new versions and flips to all of them together.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from paperlake.functions.query import Term, leaves, parse
from paperlake.operators.search import K1, LEAST_IDF, B, bm25_score, holds, tokenized, tokens
from paperlake.plans.catalog import Catalog
from paperlake.plans.lineage import shared_dir

MAX_QUERIES = 10_000  # stated queries of one call
AT_ONCE = 256  # queries that are multiplied at a time
_BUILT: dict[tuple[str, str, str], "KeywordIndex"] = {}


def _postings(docs: DataFrame) -> DataFrame:
    words = docs.select("doc_id", F.size("tokens").alias("dl"), F.posexplode("tokens").alias("pos", "term"))
    grouped = words.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"), F.sort_array(F.collect_list("pos")).alias("positions"))
    return grouped.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")


def _documents(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([c.total() for c in counts], pa.int32()), pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))],
                names=["doc_id", "dl", "terms", "tfs"],
            )

    return docs.select("doc_id", "tokens").mapInArrow(run, "doc_id bigint, dl int, terms array<string>, tfs array<int>")


class KeywordIndex:
    def __init__(self, catalog: Catalog):
        self.catalog, self.spark = catalog, catalog.spark

    def rebuild(self, docs: DataFrame) -> "KeywordIndex":
        """Index all documents of ``tokenized`` anew."""
        self.catalog.write(postings=_postings(docs), documents=_documents(docs))
        return self._counted()

    def _counted(self) -> "KeywordIndex":
        terms = self.postings().groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
        stats = self.documents().agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl"))
        self.catalog.write(terms=terms, stats=stats)
        return self

    def refresh(self, docs: DataFrame) -> "KeywordIndex":
        """Index the given documents anew, leaving the others."""
        ids = docs.select("doc_id").distinct()
        post = self.postings().join(ids, "doc_id", "left_anti").select("term", "doc_id", "tf", "dl", "positions").unionByName(_postings(docs))
        whole = self.documents().join(ids, "doc_id", "left_anti").unionByName(_documents(docs))
        self.catalog.write(postings=post.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id"), documents=whole)
        return self._counted()

    def delete(self, ids: DataFrame) -> "KeywordIndex":
        """Drop the given documents (doc_id)."""
        gone = ids.select("doc_id").distinct()
        post = self.postings().join(gone, "doc_id", "left_anti").select("term", "doc_id", "tf", "dl", "positions")
        self.catalog.write(postings=post.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id"), documents=self.documents().join(gone, "doc_id", "left_anti"))
        return self._counted()

    def postings(self) -> DataFrame:
        """(term, doc_id, tf, dl, positions)"""
        return self.catalog.read("postings")

    def documents(self) -> DataFrame:
        """(doc_id, dl, terms, tfs)"""
        return self.catalog.read("documents")

    def terms(self) -> DataFrame:
        """(term, df, cf)"""
        return self.catalog.read("terms")

    def stats(self) -> tuple[int, float]:
        row = self.catalog.read("stats").first()
        return row["docs"], row["avgdl"] or 0.0

    # --- one query

    def counted(self, leafs: list[Term]) -> DataFrame:
        """(doc_id, dl, f0, f1, …): how often each phrase occurs, for documents that hold any of their terms."""
        exact = sorted({t for leaf in leafs for t in (leaf.tokens[:-1] if leaf.prefix else leaf.tokens)})
        starts = sorted({leaf.tokens[-1] for leaf in leafs if leaf.prefix})
        wanted = reduce(Column.__or__, [F.col("term").startswith(p) for p in starts], F.col("term").isin(exact) if exact else F.lit(False))
        read = self.postings().where(wanted)
        none = F.array().cast("array<int>")
        at = {(t, False): F.coalesce(F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True), none) for t in exact}
        at |= {(p, True): F.flatten(F.collect_list(F.when(F.col("term").startswith(p), F.col("positions")))) for p in starts}
        names = {key: f"p{n}" for n, key in enumerate(at)}
        found = read.groupBy("doc_id").agg(F.max("dl").alias("dl"), *(c.alias(names[key]) for key, c in at.items()))

        def hits(leaf: Term) -> Column:
            places = [F.col(names[(t, leaf.prefix and n == len(leaf.tokens) - 1)]) for n, t in enumerate(leaf.tokens)]
            if len(places) == 1:
                return F.size(places[0])
            return F.size(F.filter(places[0], lambda x: reduce(Column.__and__, [F.array_contains(p, x + n) for n, p in enumerate(places[1:], 1)])))

        return found.select("doc_id", "dl", *(hits(leaf).cast("bigint").alias(f"f{n}") for n, leaf in enumerate(leafs)))

    def matches(self, query: str) -> DataFrame:
        """(doc_id, score) of every document that the query holds for."""
        tree = parse(query)
        if tree is None:
            return self.spark.createDataFrame([], "doc_id bigint, score double")
        said = leaves(tree)
        distinct = list(dict.fromkeys(said))
        docs, avgdl = self.stats()
        counted = self.counted(distinct)
        frequency = counted.agg(*(F.count_if(F.col(f"f{n}") > 0).alias(f"n_f{n}") for n in range(len(distinct))))  # one row
        met = counted.where(holds(tree, {t: F.col(f"f{n}") for n, t in enumerate(distinct)})).crossJoin(F.broadcast(frequency))
        return met.select("doc_id", bm25_score([f"f{distinct.index(t)}" for t in said], F.lit(docs), F.lit(avgdl)).alias("score"))

    # --- many queries

    def batch(self, queries: DataFrame, limit: int = 10, digits: int = 6) -> DataFrame:
        """(q_idx, doc_id, score, rank) of any-term queries (q_idx, q): stated queries against all documents, in blocks.

        Each block of documents is multiplied with the queries' term weights and gives its best
        for each query, so what is shuffled grows with the queries and blocks only.
        """
        asked = queries.select("q_idx", F.explode(tokens("q")).alias("term")).groupBy("q_idx", "term").agg(F.count("*").alias("times"))
        rows = asked.join(self.terms(), "term").select("q_idx", "term", "times", "df").collect()
        names = sorted({r["q_idx"] for r in rows})
        if len(names) > MAX_QUERIES:
            raise ValueError(f"more than {MAX_QUERIES} stated queries")
        docs, avgdl = self.stats()
        known = {t: n for n, t in enumerate(sorted({r["term"] for r in rows}))}
        value = {r["term"]: np.log((docs - r["df"] + 0.5) / (r["df"] + 0.5)) for r in rows}
        place = {q: n for n, q in enumerate(names)}
        cells = np.array([(known[r["term"]], place[r["q_idx"]]) for r in rows], np.int64).reshape(-1, 2)
        weights = np.array([r["times"] * (value[r["term"]] if value[r["term"]] > 0 else LEAST_IDF) for r in rows])
        shared = self.spark.sparkContext.broadcast((known, cells, weights, np.array(names, np.int64)))
        near = 10.0**-digits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, cells, weights, names = shared.value
            for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
                ids, dl = np.asarray(batch.column(0)), np.asarray(batch.column(1)).astype(np.float64)
                x = np.zeros((len(ids), len(known)))
                for n, (terms, tfs) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                    norm = K1 * (1 - B + B * dl[n] / avgdl)
                    for t, tf in zip(terms, tfs):
                        if (k := known.get(t)) is not None:
                            x[n, k] = tf * (K1 + 1) / (tf + norm)
                for at in range(0, len(names), AT_ONCE):
                    own = (cells[:, 1] >= at) & (cells[:, 1] < at + AT_ONCE)
                    w = np.zeros((len(known), min(AT_ONCE, len(names) - at)))
                    w[cells[own, 0], cells[own, 1] - at] = weights[own]
                    sums = x @ w
                    bar = np.partition(sums, len(ids) - limit, axis=0)[len(ids) - limit] - near if len(ids) > limit else np.zeros(sums.shape[1])
                    d, q = np.nonzero((sums >= bar) & (sums > 0))
                    yield pa.RecordBatch.from_arrays([pa.array(names[at + q]), pa.array(ids[d]), pa.array(sums[d, q])], names=["q_idx", "doc_id", "score"])

        if not names:
            return self.spark.createDataFrame([], "q_idx bigint, doc_id bigint, score double, rank bigint")
        found = self.documents().mapInArrow(run, "q_idx bigint, doc_id bigint, score double").withColumn("score", F.round("score", digits))
        order = Window.partitionBy("q_idx").orderBy(F.desc("score"), "doc_id")
        return found.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= limit)


def index_of(spark: SparkSession, table: DataFrame, id_col: str, text_col: str, name: str) -> KeywordIndex:
    """The index of a table's texts, built once in a session under the shared folder."""
    key = (spark.sparkContext.applicationId, name, text_col)
    if key not in _BUILT:
        root = f"{shared_dir(spark)}/paperlake-index-{abs(hash(key)):x}"
        _BUILT[key] = KeywordIndex(Catalog(spark, root)).rebuild(tokenized(table, id_col, text_col))
    return _BUILT[key]
