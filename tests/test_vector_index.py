"""The vector index against comparing all pairs."""

import numpy as np
import pytest

from palimpsest.operators import vector_index as X


def true_neighbours(asked, rows, k):
    """{query: [(record, cosine)]} by comparing all."""
    out = {}
    for key, v in asked.items():
        cos = {i: round(float(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w))), 6) for i, w in rows.items() if i != key}
        out[key] = sorted(cos.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def frames(spark, rows, asked):
    kind = "array<float>"
    r = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], f"record_id long, vector {kind}").repartition(3)
    return spark.createDataFrame([(i, v.tolist()) for i, v in asked.items()], f"query_id long, vector {kind}"), r


def recall(got, true):
    hits = sum((r["query_id"], r["record_id"]) in {(q, i) for q, own in true.items() for i, _ in own} for r in got)
    return hits / sum(map(len, true.values()))


def clusters(n, seed, dims=64):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (40, dims))
    return {i: (middle[rng.integers(40)] + rng.normal(0, 0.45, dims)).astype(np.float32) for i in range(n)}


def test_recall_on_clusters_with_few_probes(spark):
    rows = clusters(4000, 1)
    asked = {i: v for i, v in rows.items() if i % 80 == 0}
    q, r = frames(spark, rows, asked)
    index = X.build(r)
    got = X.nearest(q, r, 5, index).collect()
    assert recall(got, true_neighbours(asked, rows, 5)) >= 0.9
    # cells read, and pairs compared as they are: 20 of 4,000 records for each query
    cells = dict(X.codes(r, index).groupBy("cell").count().collect())
    read = X._probing(q, index).select("query_id", "cell").collect()
    assert sum(cells.get(x["cell"], 0) for x in read) < 0.1 * len(asked) * len(rows)
    assert X.candidates(q, X.codes(r, index), index, X.REFINE * 5).count() <= 0.01 * len(asked) * len(rows)


def test_recall_on_the_given_vectors(spark, sf_dir):
    """They are close to random, so most cells are probed; a tenth of the pairs are compared as they are."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in e.collect()}
    asked = {i: v for i, v in rows.items() if i % 20 == 0}
    q, r = frames(spark, rows, asked)
    got = X.nearest(q, r, 5).collect()
    assert recall(got, true_neighbours(asked, rows, 5)) >= 0.9
    assert X.REFINE * 5 <= 0.1 * len(rows)


def test_blocks_of_one_hot_cell_change_nothing(spark):
    """All records in one cell, dealt out in blocks of seven, queries in blocks of three."""
    rows = {i: np.ones(64) + np.random.default_rng(i).normal(0, 0.3, 64) for i in range(90)}
    asked = {i: v for i, v in rows.items() if i % 9 == 0} | {1000: np.ones(64)}
    q, r = frames(spark, rows, asked)
    index = X.build(r, cells=1)
    whole = {tuple(x) for x in X.candidates(q, X.codes(r, index), index, 12).collect()}
    parts = {tuple(x) for x in X.candidates(q, X.codes(r, index), index, 12, record_rows=7, query_rows=3).collect()}
    # the last few of almost equal codes may differ by the order of float sums
    assert len(whole) == len(parts) == 12 * len(asked) and len(whole - parts) <= len(asked) // 2
    got = {(x["query_id"], x["record_id"]): x["rank"] for x in X.nearest(q, r, 3, index).collect()}
    assert got.keys() == {(a, i) for a, own in true_neighbours(asked, rows, 3).items() for i, _ in own}


@pytest.mark.parametrize("n", [0, 1, 2, 9])
def test_few_odd_and_equal_vectors(spark, n):
    rows = [(i, [1.0] * 64) for i in range(n)] + [(100, None), (101, [1.0] * 3), (102, [0.0] * 64), (103, [float("nan")] + [1.0] * 63)]
    r = spark.createDataFrame(rows, "record_id long, vector array<double>")
    q = spark.createDataFrame([(0, [1.0] * 64), (7, None), (8, [0.0] * 64)], "query_id long, vector array<double>")
    got = X.nearest(q, r.where("record_id <> 103"), 3).collect()
    own = [x["record_id"] for x in sorted(got, key=lambda x: x["rank"]) if x["query_id"] == 0]
    assert own == [*range(1, n), 102][:3] and {x["query_id"] for x in got} <= {0, 8}
    assert X.codes(r, X.build(r)).count() == n + 2


def crowded(n, seed=3, dims=64):
    """Clusters so close that codes of a few of their vectors come out in another order, in far cells as well."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (5, dims))
    return {i: (middle[i % 5] + rng.normal(0, 0.02, dims)).astype(np.float32) for i in range(n)}


@pytest.mark.parametrize("cells", [1, 12])
def test_exact_misses_none_of_crowded_and_equal_vectors(spark, cells):
    """An index with one probe and a single value for each component; copies beyond k, blocks of a few records."""
    rows = crowded(600)
    rows |= {1000 + i: rows[3] for i in range(40)} | {2000: np.zeros(64, np.float32)}
    asked = {i: v for i, v in rows.items() if i % 20 == 3 or i >= 1030}
    q, r = frames(spark, rows, asked)
    index = X.build(r, cells=cells)
    index = X.VectorIndex(index.centroids, index.low, index.step * 16, 1)
    cos = lambda v, w: round(float(np.dot(v.astype(float), w.astype(float)) / (np.linalg.norm(v.astype(float)) * np.linalg.norm(w.astype(float)))), 6) if v.any() and w.any() else 0.0
    want = {(a, x, k + 1) for a, v in asked.items() for k, (_, x) in enumerate(sorted((-cos(v, w), i) for i, w in rows.items() if i != a)[:5])}
    for size in (X.RECORD_ROWS, 50):
        got = X.exact(q, r, 5, index, record_rows=size, query_rows=16).collect()
        assert {(x["query_id"], x["record_id"], x["rank"]) for x in got} == want
    near = X.nearest(q, r, 5, index).collect()
    assert {(x["query_id"], x["record_id"], x["rank"]) for x in near} != want  # candidates by codes alone miss some


def test_exact_without_vectors(spark):
    q, r = frames(spark, {0: np.ones(64)}, {1: np.ones(64)})
    assert X.exact(q, r.where("false"), 3).collect() == [] and X.exact(q.where("false"), r, 3).collect() == []
