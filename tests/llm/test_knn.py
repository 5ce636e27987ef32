import numpy as np

from paperlake.llm.knn import nearest, traverse


def brute(rows, k, least):
    ok = {}
    for i, v in rows:
        if v is not None and len(v) == 8 and np.isfinite(v).all() and np.linalg.norm(v) > 0:
            ok.setdefault(i, np.array(v, "f8") / np.linalg.norm(np.array(v, "f8")))
    ids = np.array(sorted(ok))
    x = np.array([ok[i] for i in ids])
    s = x @ x.T
    np.fill_diagonal(s, -2)
    out = {}
    for n, i in enumerate(ids):
        order = np.lexsort((ids, -s[n].round(6)))[:k]
        out[int(i)] = [int(ids[m]) for m in order if s[n, m] >= least]
    return out


def test_traverse_is_in_order_of_summed_distance():
    sizes = [1] * 9
    got = traverse([0.0, 1.0, 5.0], [0, 1, 2], [0.0, 2.0, 3.0], [0, 1, 2], 3, sizes, 6)
    assert got == [0, 3, 1, 2, 4, 5] and traverse([0.0], [0], [0.0], [0], 1, [5], 99) == [0]


def test_recall_and_copies(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(150, 8))
    rows = [(n, (base[n % 150] + 0.15 * rng.normal(size=8)).astype("f4").tolist()) for n in range(1500)]
    rows += [(5000 + n, [1.0] + [0.0] * 7) for n in range(60)]  # copies of one vector
    rows += rows[:5] + [(9001, None), (9002, []), (9003, [0.0] * 8), (9004, [float("nan")] * 8), (9005, [1.0] * 3)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "chunk_id bigint, embedding array<float>, vec string")
    got = nearest(df, "chunk_id", "embedding", 8, k=5, sample_rows=800, block=64).collect()
    mine = {}
    for r in sorted(got, key=lambda r: (r.id, r["rank"])):
        mine.setdefault(r.id, []).append(r.neighbour_id)
    true = brute(rows, 5, -1)
    recall = np.mean([len(set(mine.get(i, [])) & set(t)) / len(t) for i, t in true.items()])
    assert set(mine) == set(true) and recall >= 0.9
    assert mine[5000] == [5001, 5002, 5003, 5004, 5005] and mine[5059] == [5000, 5001, 5002, 5003, 5004]
    assert nearest(df.limit(0), "chunk_id", "embedding", 8).count() == 0


def test_codes_lose_no_pair_over_the_threshold(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 8))
    rows = [(n, (base[n % 40] + 0.2 * rng.normal(size=8)).astype("f4").tolist()) for n in range(400)]
    df = spark.createDataFrame(rows, "chunk_id bigint, embedding array<float>")
    got = nearest(df, "chunk_id", "embedding", 8, k=400, min_similarity=0.97, candidates=10_000).collect()
    true = brute(rows, 400, 0.97)
    assert {(r.id, r.neighbour_id) for r in got} == {(i, j) for i, js in true.items() for j in js} and all(r.similarity >= 0.97 for r in got)
