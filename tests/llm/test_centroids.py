import hashlib
import random

import numpy as np
import pytest

from palimpsest.llm import centroids, queries


def by_hand(vectors, k=8, rounds=10):
    """Lloyd's method, one vector at a time, in Python's integers."""
    kept = []
    for key, v in vectors:
        if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v):
            kept.append((key, [int(np.floor(float(x) * 1024)) for x in v]))
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    means = [v for _, v in first[:k]]
    place = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), i) for i, m in enumerate(means))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(place(v)[1], []).append(v)
        means = [[sum(x) // len(groups[i]) for x in zip(*groups[i], strict=True)] if i in groups else m for i, m in enumerate(means)]
    rows = [(key, *place(v)[::-1]) for key, v in kept]
    spent = {c: sum(d for _, own, d in rows if own == c) for c in {r[1] for r in rows}}
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    return sorted(((key, c, d, spent[c], sum(spent.values()), sha[c]) for key, c, d in rows), key=str)


KIND = "vec_id long, embedding array<float>, label int, cluster int, distance string, v string, id int"


def frame(spark, vectors):
    return spark.createDataFrame([(key, v, 1, 7, "x", "y", 5) for key, v in vectors], KIND).repartition(3)


def made(n, seed):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    return [(i, [float(np.float32(x + rng.gauss(0, 0.3))) for x in rng.choice(middle)]) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_method_by_hand(spark, seed):
    vectors = made(60, seed)
    odd = [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [None] + [1.0] * 63), (105, [float("nan")] * 64), (106, [float("inf")] + [0.0] * 63)]
    same = [(200 + i, vectors[0][1]) for i in range(20)] + [(7, vectors[7][1]), (None, vectors[3][1]), (2**60 + 1, [-0.00001] * 64)]
    rows = centroids.cluster(frame(spark, vectors + odd + same)).collect()
    assert sorted((tuple(r) for r in rows), key=str) == by_hand(vectors + same)


def test_few_equal_huge_and_no_vectors(spark):
    assert centroids.cluster(frame(spark, [(1, None)])).collect() == []
    few = made(3, 5)
    assert sorted((tuple(r) for r in centroids.cluster(frame(spark, few)).collect()), key=str) == by_hand(few)
    equal = [(i, [0.5] * 64) for i in range(30)]
    assert {(r["cluster"], r["distance"]) for r in centroids.cluster(frame(spark, equal)).collect()} == {(0, 0)}
    huge = [(i, [3e38 * (-1) ** i] * 64) for i in range(12)]
    rows = centroids.cluster(frame(spark, huge)).collect()
    assert len(rows) == 12 and {r["distance"] for r in rows} == {0}


def test_equal_distances_take_the_smaller_number():
    found, least = centroids.nearest(np.array([[0, 0], [5, 5]]), np.array([[1, 0], [0, 1], [5, 5], [5, 5]]))
    assert found.tolist() == [0, 2] and least.tolist() == [1, 0]


def test_query_takes_the_whole_table(spark, sf_dir):
    rows = queries.op13_lloyd(spark, sf_dir).collect()
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in rows), key=str) == by_hand(table)
