"""Most similar vectors for every vector, by an inverted multi-index.

Each vector's two halves are quantised separately (k-means on a bounded sample), so K
centroids a half give K*K cells. For a vector the centroid pairs are traversed in the order
of summed distance with a heap, until the visited cells hold enough entries; the entries of
those cells are then reranked with exact cosine similarity.

How many entries are enough is measured, not guessed: ``probes`` stated vectors are compared
with all rows, block by block, and the traversal is made as long as finds ``recall`` of their
true neighbours. Vectors with near neighbours need few entries; where the k-th neighbour is
hardly nearer than the mean (random directions), no index can do with few.

Scale. A cell is a shuffle key, so a vector is sent once as an entry and once to each cell
it visits; nothing is compared outside a cell. With a threshold the copies that are sent are
codes of a byte a place, whose error is bounded, and only pairs that may reach the threshold
are compared exactly, by a join with the vectors. Cells over ``block`` entries are split by a
salt. Exact copies are folded into one class first and unfolded by position at the end, so a
vector that holds a third of all rows costs one entry. The centroids, the probes with their
neighbours and the K*K cell sizes go to the driver; K grows with the root of the rows up to
``max_centroids`` (cell sizes of 128 MB).

Defined results: null, empty, all-zero, NaN-holding, null-holding and wrong-length vectors
take no part; repeated rows count once; an id with several vectors stands for each of them;
neighbours are ordered by similarity, then by smaller id; an empty table gives no row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from paperlake.functions.vectors import to_binary, to_matrix, valid_unit
from paperlake.plans.lineage import materialize

SAMPLE_ROWS = 20_000  # rows that the centroids are fitted on; every row is indexed
MAX_CENTROIDS = 4_096
CELL_TARGET = 8  # mean entries of a cell that K aims at
RECALL, PROBES = 0.95, 512  # share of true neighbours that is aimed at, vectors it is measured on
CANDIDATES = 200  # entries that a traversal gathers where the probes have too few neighbours to tell
ROUTED = 1_000  # vectors that a task routes at a time; each goes out a dozen times
BLOCK = 4_096  # entries of one block of a large cell
UNFOLD_BLOCK = 20_000  # copies of one class that a task unfolds


def _kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), k, replace=False)].astype(np.float32)
    for _ in range(rounds):
        label = np.argmin((centres**2).sum(1) - 2 * points @ centres.T, axis=1)
        order = np.argsort(label, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(label[order]) > 0])
        used = label[order][starts]
        sums = np.add.reduceat(points[order], starts, axis=0)
        centres[used] = sums / np.diff(np.r_[starts, len(order)])[:, None]
    return centres


def _distances(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((vectors**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * vectors @ centres.T, 0)


def traverse(d1: list[float], o1: list[int], d2: list[float], o2: list[int], k: int, sizes, enough: int) -> list[int]:
    """Cells in the order of summed distance until they hold ``enough`` entries.

    d1, d2 are the ascending distances to the centroids o1, o2 of either half.
    """
    heap, cells, got, n1, n2 = [(d1[0] + d2[0], 0, 0)], [], 0, len(o1), len(o2)
    while heap and got < enough:
        _, i, j = heapq.heappop(heap)
        cell = o1[i] * k + o2[j]
        if size := sizes[cell]:
            cells.append(cell)
            got += size
        if i + 1 < n1:
            heapq.heappush(heap, (d1[i + 1] + d2[j], i + 1, j))
        if i == 0 and j + 1 < n2:
            heapq.heappush(heap, (d1[0] + d2[j + 1], 0, j + 1))
    return cells


def nearest(
    df: DataFrame,
    id_col: str,
    vec_col: str,
    dim: int,
    k: int = 10,
    min_similarity: float = -1.0,
    candidates: int | None = None,
    recall: float = RECALL,
    probes: int = PROBES,
    sample_rows: int = SAMPLE_ROWS,
    block: int = BLOCK,
    max_centroids: int = MAX_CENTROIDS,
) -> DataFrame:
    """(id, neighbour_id, similarity, rank): for every vector its k most similar ones.

    Only neighbours of at least ``min_similarity`` come out. Both directions of a compared
    pair count, so a pair is found if either vector's traversal reaches the other. candidates:
    entries that a traversal gathers, by default as many as ``recall`` needs.
    """
    coded = min_similarity > 0

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, unit = valid_unit(batch.column(1), dim)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), to_binary(unit)], names=["id", "vec"])

    source = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vec_col}`").cast("array<float>").alias("v"))
    rows = source.where(F.col("id").isNotNull() & (F.size("v") == dim)).mapInArrow(clean, "id bigint, vec binary")
    rows = materialize(rows, "knn-rows")
    classes = rows.groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "knn-classes")
    total = classes.count()
    spark = df.sparkSession
    if total == 0:
        return spark.createDataFrame([], "id bigint, neighbour_id bigint, similarity double, rank int")

    slots = 1 << 20
    keep = min(slots, -(-sample_rows * slots // total))
    sample = classes.where(F.pmod(F.xxhash64("cid"), F.lit(slots)) < keep).select("vec").toArrow()
    points = to_matrix(sample.column(0), dim)
    if len(points) == 0:
        points = to_matrix(classes.select("vec").limit(1).toArrow().column(0), dim)
    size_k = 2 ** max(0, round(np.log2(max(1.0, total / CELL_TARGET) ** 0.5)))
    size_k = int(min(size_k, max_centroids, len(points)))
    half = dim // 2
    centres = (_kmeans(points[:, :half], size_k), _kmeans(points[:, half:], size_k))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = to_matrix(batch.column(0), dim)
            cell = _distances(x[:, :half], centres[0]).argmin(1) * size_k + _distances(x[:, half:], centres[1]).argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32))], names=["cell"])

    sizes = np.zeros(size_k * size_k, np.int64)
    for cell, count in classes.select("vec").mapInArrow(assign, "cell int").groupBy("cell").count().collect():
        sizes[cell] = count
    shared = spark.sparkContext.broadcast(sizes)
    if candidates is None:
        candidates = _enough(classes, total, dim, k, min_similarity, recall, probes, centres, sizes)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = shared.value.tolist()
        splits = np.maximum(1, -(-shared.value // block))
        for batch in (b.slice(at, ROUTED) for b in batches for at in range(0, b.num_rows, ROUTED)):
            cid, rep = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            x = to_matrix(batch.column(0), dim)
            orders, dists, own = [], [], []
            for part, c in ((x[:, :half], centres[0]), (x[:, half:], centres[1])):
                d = _distances(part, c)
                order = np.argsort(d, axis=1, kind="stable")
                orders.append(order.tolist())
                dists.append(np.take_along_axis(d, order, 1).tolist())
                own.append(d.argmin(1))
            home = own[0] * size_k + own[1]
            cells, salts, kinds, at = [home], [cid % splits[home]], [np.zeros(len(x), np.int8)], [np.arange(len(x))]
            to, who = [], []
            for r in range(len(x)):
                visited = traverse(dists[0][r], orders[0][r], dists[1][r], orders[1][r], size_k, sizes, candidates)
                to += visited
                who += [r] * len(visited)
            to, who = np.array(to, np.int64), np.array(who, np.int64)
            times = splits[to]
            cells.append(np.repeat(to, times))
            at.append(np.repeat(who, times))
            salts.append(np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
            kinds.append(np.ones(len(at[1]), np.int8))
            at = np.concatenate(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(cells).astype(np.int32)), pa.array(np.concatenate(salts).astype(np.int32)), pa.array(np.concatenate(kinds)),
                 pa.array(cid[at]), pa.array(rep[at]), (_codes(x) if coded else to_binary(x)).take(pa.array(at))],
                names=["cell", "salt", "kind", "cid", "rep", "vec"],
            )

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block_rows = None, [], None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            cell, salt, kind, cid, rep = (np.asarray(batch.column(i)) for i in range(5))
            x, error = _decoded(batch.column(5), dim) if coded else (to_matrix(batch.column(5), dim), np.zeros(batch.num_rows, np.float32))
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(salt) != 0) | (np.diff(kind) != 0)) + 1
            found: list[tuple[np.ndarray, ...]] = []
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(cell)]):
                if (cell[a], salt[a]) != key:
                    key, held, block_rows = (cell[a], salt[a]), [], None
                if kind[a] == 0:
                    held.append((cid[a:b].copy(), rep[a:b].copy(), x[a:b].copy(), error[a:b].copy()))
                    continue
                if block_rows is None:
                    if not held:
                        continue
                    block_rows = [np.concatenate(p) for p in zip(*held)]
                e_cid, e_rep, e_x, e_error = block_rows
                for s in range(a, b, 2048):
                    t = min(b, s + 2048)
                    sims = x[s:t] @ e_x.T
                    sims[cid[s:t, None] == e_cid[None, :]] = -2
                    slack = error[s:t] + e_error.max()  # no similarity is further off
                    bar = max(min_similarity, -1.0) - 1e-5 - slack
                    if len(e_cid) > k:
                        bar = np.maximum(bar, np.partition(sims, len(e_cid) - k, axis=1)[:, len(e_cid) - k] - 1e-6 - 2 * slack)
                    q, e = np.nonzero(sims >= bar[:, None])
                    if len(q):
                        exact = sims[q, e].astype(np.float64) if coded else np.einsum("ij,ij->i", x[s:t][q].astype(np.float64), e_x[e].astype(np.float64))
                        ok = slice(None) if coded else exact >= min_similarity
                        found.append((cid[s:t][q][ok], rep[s:t][q][ok], e_cid[e][ok], e_rep[e][ok], np.minimum(exact[ok], 1.0)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in zip(*found)], names=["q", "q_rep", "e", "e_rep", "sim"])

    routed = classes.select("vec", "cid", "rep").mapInArrow(route, "cell int, salt int, kind tinyint, cid bigint, rep bigint, vec binary")
    routed = routed.repartition("cell", "salt").sortWithinPartitions("cell", "salt", "kind", "rep")
    hits = routed.mapInArrow(match, "q bigint, q_rep bigint, e bigint, e_rep bigint, sim double")
    hits = materialize(hits, "knn-hits")
    if coded:
        hits = _exact(hits, classes, dim, min_similarity)
    both = hits.select("q", "e", "e_rep", "sim").union(hits.select(F.col("e").alias("q"), F.col("q").alias("e"), F.col("q_rep").alias("e_rep"), "sim")).distinct()
    by = Window.partitionBy("q").orderBy(F.desc("sim"), "e_rep", "e")
    lists = both.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1)
    return _unfold(rows, classes, lists, k)


def _codes(x: np.ndarray) -> pa.Array:
    """Rows as bytes: the largest size of a place (4 bytes), then each place as a share of it in a byte."""
    top = np.abs(x).max(1, keepdims=True).astype(np.float32) + np.float32(1e-12)
    rows = np.concatenate([top.view(np.uint8).reshape(len(x), 4), np.rint(x / top * 127).astype(np.int8).view(np.uint8)], axis=1)
    offsets = np.arange(len(x) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _decoded(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, bound of the error of a similarity with a unit vector) of coded rows."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    rows = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(len(column), dim + 4)
    top = np.ascontiguousarray(rows[:, :4]).view(np.float32)
    x = np.ascontiguousarray(rows[:, 4:]).view(np.int8).astype(np.float32) * (top / 127)
    return x, 1.01 * np.sqrt(np.float32(dim)) * top[:, 0] / 254


def _exact(hits: DataFrame, classes: DataFrame, dim: int, min_similarity: float) -> DataFrame:
    """The hits whose exact similarity reaches the threshold, with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (to_matrix(batch.column(i), dim).astype(np.float64) for i in (4, 5))
            sim = np.minimum(np.einsum("ij,ij->i", x, y), 1.0)
            ok = pa.array(np.flatnonzero(sim >= min_similarity))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(ok) for i in range(4)), pa.array(sim).take(ok)], names=["q", "q_rep", "e", "e_rep", "sim"])

    vecs = classes.select("cid", "vec")
    low, high = F.least("q", "e"), F.greatest("q", "e")  # both directions are compared once
    pairs = hits.select(low.alias("q"), F.when(F.col("q") <= F.col("e"), F.col("q_rep")).otherwise(F.col("e_rep")).alias("q_rep"), high.alias("e"), F.when(F.col("q") <= F.col("e"), F.col("e_rep")).otherwise(F.col("q_rep")).alias("e_rep")).distinct()
    met = pairs.join(vecs.toDF("q", "x"), "q").join(vecs.toDF("e", "y"), "e").select("q", "q_rep", "e", "e_rep", "x", "y")
    return materialize(met.mapInArrow(run, "q bigint, q_rep bigint, e bigint, e_rep bigint, sim double"), "knn-exact")


def _enough(classes: DataFrame, total: int, dim: int, k: int, min_similarity: float, recall: float, probes: int, centres, sizes: np.ndarray) -> int:
    """Entries that a traversal must gather for ``recall`` of the true neighbours of some stated vectors."""
    slots, spark = 1 << 20, classes.sparkSession
    keep = min(slots, -(-probes * slots // total))
    asked = classes.where(F.pmod(F.xxhash64(F.lit("probe"), "cid"), F.lit(slots)) < keep).select("cid", "vec").toArrow()
    if len(asked) == 0:
        return CANDIDATES
    names, queries = np.asarray(asked.column(0)), to_matrix(asked.column(1), dim).copy()
    shared = spark.sparkContext.broadcast((names, queries))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            cid, x = np.asarray(batch.column(0)), to_matrix(batch.column(1), dim)
            sims = queries @ x.T
            sims[names[:, None] == cid[None, :]] = -2
            bar = np.partition(sims, len(cid) - k, axis=1)[:, len(cid) - k] if len(cid) > k else np.full(len(names), -1.5)
            q, e = np.nonzero(sims >= np.maximum(bar, min_similarity)[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(sims[q, e].astype(np.float64)), batch.column(1).take(pa.array(e))], names=["q", "sim", "vec"])

    near = classes.select("cid", "vec").mapInArrow(compare, "q bigint, sim double, vec binary")
    top = Window.partitionBy("q").orderBy(F.desc("sim"), "vec")
    true = near.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).select("q", "vec").toArrow()
    if len(true) < 30:
        return CANDIDATES
    q, y, half = np.asarray(true.column(0)), to_matrix(true.column(1), dim), dim // 2
    size_k = len(centres[0])
    grid = sizes.reshape(size_k, size_k)

    def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _distances(x[:, :half], centres[0]), _distances(x[:, half:], centres[1])

    needs = np.empty(len(q), np.int64)
    for at in range(0, len(q), 1024):
        (a1, a2), (b1, b2) = halves(queries[q[at : at + 1024]]), halves(y[at : at + 1024])
        for n in range(len(a1)):
            both = []
            for (d1, d2), (h1, h2) in (((a1[n], a2[n]), (b1[n], b2[n])), ((b1[n], b2[n]), (a1[n], a2[n]))):
                order = np.argsort(d2)
                reach = np.searchsorted(d2[order], d1[h1.argmin()] + d2[h2.argmin()] - d1, "right")  # centroids of the second half that come before the cell
                sums = np.concatenate([np.zeros((size_k, 1), np.int64), grid[:, order].cumsum(1)], axis=1) if size_k <= 256 else None
                both.append(int(sums[np.arange(size_k), reach].sum()) if sums is not None else int(sum(grid[i, order[:r]].sum() for i, r in enumerate(reach) if r)))
            needs[at + n] = min(both)
    needs.sort()
    return int(max(needs[min(len(needs) - 1, int(np.ceil(recall * len(needs))))], 2 * k))


def _unfold(rows: DataFrame, classes: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """From classes of exact copies to rows: every copy gets its own k neighbours."""
    folded = classes.where("n > 1").select("cid", "vec", "n")
    copies = rows.join(folded, "vec").select("cid", "id", "n").distinct()
    copies = materialize(copies, "knn-copies")
    first = Window.partitionBy("cid").orderBy("id")
    heads = copies.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).select(F.col("cid").alias("e"), F.col("id").alias("nb"))
    others = lists.join(heads, "e", "left").select(F.col("q").alias("cid"), F.coalesce("nb", "e_rep").alias("nb"), "sim")
    same = heads.select(F.col("e").alias("cid"), "nb", F.lit(1.0).alias("sim"))
    top = Window.partitionBy("cid").orderBy(F.desc("sim"), "nb")
    ranked = others.union(same).withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1)
    packed = ranked.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("r", "nb", "sim"))).alias("near"))
    singles = classes.where("n = 1").select("cid", F.col("rep").alias("id"))
    alone = packed.join(singles, "cid").select("id", "near")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / UNFOLD_BLOCK)).cast("int")
    parted = copies.withColumn("part", F.pmod(F.hash("id"), blocks))
    spread = packed.join(copies.groupBy("cid").agg(F.max("n").alias("n")), "cid")
    spread = spread.select("cid", "near", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("part"))
    many = parted.join(spread, ["cid", "part"]).select("id", "near")
    near = F.slice(F.filter("near", lambda x: x.nb != F.col("id")), 1, k)
    return alone.union(many).select("id", F.posexplode(near).alias("p", "x")).select(
        "id", F.col("x.nb").alias("neighbour_id"), F.col("x.sim").alias("similarity"), (F.col("p") + 1).cast("int").alias("rank")
    )
