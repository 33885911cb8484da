"""Plain Lloyd clustering in exact integers.

Vectors are scaled to integers once and written to the shared folder. Each round broadcasts the
centroids; tasks subtract them from their vectors, and give for each centroid the number and the
componentwise sum of its vectors; those few rows of each task merge in a groupBy. What comes to
the driver is one number for each component of a centroid. Integers make every order of adding give one result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import table

#: Scaled components are held within plus and minus this, so that a squared distance of 64 of them is a long.
MOST = 1 << 27
#: Vectors compared at a time in a task.
STEP = 4096
_LONG = (1 << 63) - 1


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, size: int, scale: int) -> DataFrame:
    """(id, v array<int>) of the vectors of `size` components, none null or non-finite; v is floor(scale * x)."""
    v = F.col("v")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    held = lambda x: F.greatest(F.lit(float(-MOST)), F.least(F.lit(float(MOST)), x * F.lit(float(scale))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where((F.size(v) == size) & F.coalesce(whole, F.lit(False)))
    return rows.select("id", F.transform(v, lambda x: F.floor(held(x)).cast("int")).alias("v"))


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each point, the smaller of equals, and its squared distance."""
    found, least = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
    for a in range(0, len(points), STEP):
        part = points[a : a + STEP]
        far = np.empty((len(centroids), len(part)), np.int64)
        for k, c in enumerate(centroids):
            d = part - c
            far[k] = np.einsum("ij,ij->i", d, d)
        found[a : a + STEP] = far.argmin(axis=0)
        least[a : a + STEP] = far.min(axis=0)
    return found, least


def _points(batch: pd.DataFrame, size: int) -> np.ndarray:
    return np.concatenate(batch["v"].to_list()).astype(np.int64).reshape(-1, size) if len(batch) else np.zeros((0, size), np.int64)


def seeds(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of salt and id, in that order; a null id comes last, ties by components."""
    h = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    first = rows.orderBy(h.asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in first], np.int64)


def lloyd(rows: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """The centroids after `rounds` rounds over (id, v); centroids without vectors stay."""
    size = centroids.shape[1]
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(centroids)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            own = shared.value
            n, total = np.zeros(len(own), np.int64), np.zeros(own.shape, np.int64)
            for batch in batches:
                points = _points(batch, size)
                found, _ = nearest(points, own)
                n += np.bincount(found, minlength=len(own))
                for k in np.unique(found):
                    total[k] += points[found == k].sum(axis=0)
            seen = np.flatnonzero(n)
            yield pd.DataFrame({
                "cluster": np.repeat(seen, size).astype(np.int32), "place": np.tile(np.arange(size, dtype=np.int32), len(seen)),
                "n": np.repeat(n[seen], size), "total": total[seen].ravel(),
            })

        parts = rows.mapInPandas(run, "cluster int, place int, n long, total long")
        merged = parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect()
        centroids = centroids.copy()
        for r in merged:
            centroids[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
        shared.unpersist()
    return centroids


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, salt: str = "3:") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each kept vector.

    Kept are vectors of exactly `size` components, none null or non-finite; the others, null and
    empty ones among them, are in no cluster. Components count as integers floor(scale * x), held
    within plus and minus 2**27. The first centroids are `seeds`; each of the rounds assigns and
    then averages (floor), and a last pass assigns. Rows with null or repeated ids are vectors of
    their own; repeated vectors may be seeds more than once, and the smaller number wins ties. With
    fewer than k vectors there are as many centroids; an empty table gives an empty result. Sums of
    distances beyond a long stop at its largest value. Other columns aren't read.
    """
    spark = vectors.sparkSession
    rows = table(integer_vectors(vectors, id_col, vector_col, size, scale), "vectors")
    centroids = seeds(rows, k, salt)
    kinds = "cluster int, distance long"
    if not len(centroids):
        return spark.createDataFrame([], f"id long, {kinds}, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = lloyd(rows, centroids, rounds)
    shared = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, least = nearest(_points(batch, size), shared.value)
            yield pd.DataFrame({"id": batch["id"], "cluster": found.astype(np.int32), "distance": least})

    named = rows.withColumn("id", F.col("id").cast("string"))  # pandas has no longs with nulls
    assigned = table(named.mapInPandas(run, f"id string, {kinds}").withColumn("id", F.col("id").cast("long")), "assigned")
    spent = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    inertia = min(sum(spent.values()), _LONG)
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    told = [(c, min(s, _LONG), inertia, digest(centroids[c])) for c, s in spent.items()]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(told), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
