"""Nearest vectors through an index: cells around centroids, one byte a component, an exact check at the end.

`nearest` probes a number of cells and may miss neighbours; `exact` bounds what codes can be wrong by
and misses none.

Centroids are fitted in one task on a bounded sample; every vector gets the cell of its nearest
centroid and a code of what is left, a byte for each component. A query probes cells in the order
of their distance; how many is set on the sample, so that its true neighbours lie in them. Codes
of a probed cell are compared in blocks, and only the best few of each query are fetched and
compared as they are.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.files import held
from .retrieval import top_k

#: Vectors of the sample and cells at most, vectors that set the number of probes, and rounds of fitting.
MOST_SAMPLE, MOST_CELLS, MOST_ASKED, ROUNDS = 32_768, 2_048, 256, 8
#: Candidates for each row of the result that are compared as they are, and rows of a block.
REFINE, RECORD_ROWS, QUERY_ROWS = 4, 16_384, 4_096
#: What sums of floats and rounded scores can be wrong by, in a cosine, and queries that are probed at a time.
SLACK, AT_ONCE = 2e-5, 256


@dataclass(frozen=True)
class VectorIndex:
    centroids: np.ndarray
    low: np.ndarray  # of what is left, by component
    step: np.ndarray
    probes: int

    @property
    def cells(self) -> int:
        return len(self.centroids)

    def order(self, unit_vectors: np.ndarray) -> np.ndarray:
        """The cells of each vector, the nearest first."""
        return np.argsort(-(unit_vectors @ self.centroids.T - (self.centroids**2).sum(axis=1) / 2), axis=1, kind="stable")

    def encode(self, unit_vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector, and its code."""
        near = unit_vectors @ self.centroids.T - (self.centroids**2).sum(axis=1) / 2
        cell = near.argmax(axis=1)
        return cell, np.clip(np.rint((unit_vectors - self.centroids[cell] - self.low) / self.step), 0, 255).astype(np.uint8)

    def decode(self, cell: int, codes: np.ndarray) -> np.ndarray:
        return (self.centroids[cell] + self.low + codes * self.step).astype(np.float32)


def unit(column: pa.Array | list, dims: int) -> np.ndarray:
    """Rows of length 1; those without length, or with values that aren't finite, are 0."""
    rows = np.array(column.to_pylist() if isinstance(column, pa.Array) else column, dtype=np.float64).reshape(-1, dims)
    rows[~np.isfinite(rows).all(axis=1)] = 0
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def fit(rows: np.ndarray, cells: int, k: int, target: float) -> VectorIndex:
    """Lloyd's rounds over unit vectors; as many probes as hold `target` of the k nearest of some of them."""
    centroids = rows[np.linspace(0, len(rows) - 1, cells).astype(int)].copy()
    nearest = lambda: np.concatenate([(x @ centroids.T - (centroids**2).sum(axis=1) / 2).argmax(axis=1) for x in np.array_split(rows, -(-len(rows) // 4096))])
    for _ in range(ROUNDS):
        own = nearest()
        n = np.bincount(own, minlength=cells)
        total = np.zeros_like(centroids)
        np.add.at(total, own, rows)
        centroids[n > 0] = total[n > 0] / n[n > 0, None]
    own = nearest()
    left = rows - centroids[own]
    low, high = left.min(axis=0), left.max(axis=0)
    margin = np.maximum((high - low) * 0.05, 1e-6)  # the sample's ends aren't those of all
    low, step = low - margin, (high - low + 2 * margin) / 255
    asked = np.linspace(0, len(rows) - 1, min(MOST_ASKED, len(rows))).astype(int)
    index, ranks = VectorIndex(centroids, low, step, cells), []
    for i in asked:
        scores = rows @ rows[i]
        scores[i] = -np.inf
        best = np.argpartition(-scores, min(k, len(rows) - 1))[:k]
        place = np.empty(cells, int)
        place[index.order(rows[i : i + 1])[0]] = np.arange(cells)
        ranks += place[own[best]].tolist()
    probes = int(np.quantile(ranks, target, method="higher")) + 1 if ranks and len(rows) > 1 else cells
    return VectorIndex(centroids, low, step, min(cells, probes))


def build(records: DataFrame, k: int = 5, target: float = 0.99, cells: int | None = None, most: int = MOST_SAMPLE, dims: int = 64) -> VectorIndex:
    """The index of records (record_id, vector), fitted in one task on at most `most` of them, chosen by a hash.

    cells is by default about the root of the number of records. Null vectors and those of other
    than `dims` components are in no index. What comes to the driver are the centroids.
    """
    rows = records.where(F.size("vector") == dims).select("record_id", F.col("vector").cast("array<double>").alias("vector"))
    n = rows.count()
    cells = max(1, min(cells or int(n**0.5), MOST_CELLS, max(1, min(n, most) // 8)))
    sample = rows.orderBy(F.xxhash64("record_id"), "record_id").limit(most).select("vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [unit(b.column(0), dims) for b in batches]
        if own:
            out = io.BytesIO()
            np.savez(out, **asdict(fit(np.concatenate(own), cells, k, target)))
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["index"])

    made = sample.repartition(1).mapInArrow(run, "index binary").collect()
    if not made:
        return VectorIndex(np.zeros((1, dims)), np.zeros(dims), np.ones(dims), 1)
    with np.load(io.BytesIO(made[0]["index"])) as parts:
        return VectorIndex(parts["centroids"], parts["low"], parts["step"], int(parts["probes"]))


def codes(records: DataFrame, index: VectorIndex) -> DataFrame:
    """(record_id, cell, code): every record with a vector of the index's size."""
    dims = index.centroids.shape[1]
    shared = records.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, code = shared.value.encode(unit(b.column(1), dims))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary())], names=["record_id", "cell", "code"])

    rows = records.where(F.size("vector") == dims).select(F.col("record_id").cast("long").alias("record_id"), F.col("vector").cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, "record_id long, cell int, code binary")


def _probing(queries: DataFrame, index: VectorIndex) -> DataFrame:
    """(query_id, vector, cell): a row for each cell that a query probes."""
    dims, shared = index.centroids.shape[1], queries.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, AT_ONCE) for whole in batches for i in range(0, len(whole), AT_ONCE)):
            rows = unit(b.column(1), dims)
            cells = shared.value.order(rows)[:, : shared.value.probes].astype(np.int32)
            at = np.repeat(np.arange(len(rows)), cells.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(list(rows[at].astype(np.float32)), pa.list_(pa.float32())), pa.array(cells.ravel())], names=["query_id", "vector", "cell"])

    rows = queries.where(F.size("vector") == dims).select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, "query_id long, vector array<float>, cell int")


def _block(shared, k: int, apart: bool):
    """The k best records of a block for each of its queries, by their codes."""

    def run(queries: pa.Table, records: pa.Table) -> pa.Table:
        best, dims = [], shared.value.centroids.shape[1]
        if len(queries) and len(records):
            asked, own = queries.column("query_id").to_numpy(), records.column("record_id").to_numpy()
            left = np.array(queries.column("vector").to_pylist(), np.float32).reshape(-1, dims)
            code = np.frombuffer(b"".join(records.column("code").to_pylist()), np.uint8).reshape(-1, dims)
            right = shared.value.decode(records.column("cell")[0].as_py(), code)
            for a in range(0, len(asked), 64):
                scores = left[a : a + 64] @ right.T
                if apart:
                    scores[asked[a : a + 64, None] == own] = -np.inf
                for i, row in enumerate(scores):
                    at = np.argpartition(-row, k - 1)[:k] if len(row) > k else np.arange(len(row))
                    at = at[row[at] > -np.inf]
                    best.append((np.full(len(at), asked[a + i]), own[at], row[at].astype(np.float64)))
        columns = [np.concatenate(c) for c in zip(*best, strict=True)] if best else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "record_id", "near"), columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    return run


def candidates(queries: DataFrame, coded: DataFrame, index: VectorIndex, most: int, record_rows: int = RECORD_ROWS, query_rows: int = QUERY_ROWS, apart: bool = True) -> DataFrame:
    """(query_id, record_id): the `most` best records of each query by their codes, among those of probed cells.

    A cell of many records, or one that many queries probe, is dealt out in blocks; only the sizes
    of the index's cells are joined by broadcast.
    """
    asked = held(_probing(queries, index))
    sizes = coded.groupBy("cell").agg(F.ceil(F.count("*") / record_rows).cast("int").alias("r_parts"))
    loads = asked.groupBy("cell").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("q_parts"))
    parts = F.broadcast(held(sizes.join(loads, "cell")))  # a row for each of at most MOST_CELLS cells
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    q = asked.join(parts, "cell").select("query_id", "vector", "cell", own("query_id", "q_parts").alias("q_part"), each("r_parts").alias("r_part"))
    r = coded.join(parts, "cell").select("record_id", "code", "cell", own("record_id", "r_parts").alias("r_part"), each("q_parts").alias("q_part"))
    shared = queries.sparkSession.sparkContext.broadcast(index)
    blocks = q.groupBy("cell", "q_part", "r_part").cogroup(r.groupBy("cell", "q_part", "r_part"))
    found = blocks.applyInArrow(_block(shared, most, apart), "query_id long, record_id long, near double")
    return top_k(found, most, score="near").select("query_id", "record_id")


def nearest(queries: DataFrame, records: DataFrame, k: int, index: VectorIndex | None = None, coded: DataFrame | None = None, target: float = 0.99, refine: int = REFINE, digits: int = 6, dims: int = 64, apart: bool = True) -> DataFrame:
    """(query_id, record_id, score, rank): the k records of highest cosine, rounded; ties go to the lower id.

    queries has query_id and vector, records record_id and vector. Without an index and codes they
    are made here. Of each query refine * k candidates are compared as they are. Null vectors and
    those of another size don't count, nor, with apart, a record of the query's own id. Ids are longs.
    """
    index = index or build(records, k, target, dims=dims)
    coded = held(codes(records, index)) if coded is None else coded
    pairs = candidates(queries, coded, index, refine * k, apart=apart)
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").alias("_q"))
    r = records.select(F.col("record_id").cast("long").alias("record_id"), F.col("vector").alias("_r"))
    scored = pairs.join(q, "query_id").join(r, "record_id").select("query_id", "record_id", F.round(V.cosine(F.col("_q"), F.col("_r")), digits).alias("score"))
    return top_k(scored, k)


def bounded_codes(records: DataFrame, index: VectorIndex) -> DataFrame:
    """(record_id, cell, code, wrong, far, twin): codes with their distance from the vector, the vector's from its centroid, and a hash that equal vectors share."""
    dims, shared = index.centroids.shape[1], records.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = unit(b.column(1), dims), shared.value
            cell, code = x.encode(rows)
            wrong = np.linalg.norm(rows - (x.centroids[cell] + x.low + code * x.step), axis=1)
            far = np.linalg.norm(rows - x.centroids[cell], axis=1)
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(wrong), pa.array(far), b.column(2),
            ], names=["record_id", "cell", "code", "wrong", "far", "twin"])

    rows = records.where(F.size("vector") == dims).select(F.col("record_id").cast("long").alias("record_id"), F.col("vector").cast("array<double>").alias("vector"))
    return rows.withColumn("twin", F.xxhash64("vector")).mapInArrow(run, "record_id long, cell int, code binary, wrong double, far double, twin long")


def _blocks_of(index: VectorIndex, sizes: dict[int, tuple[int, float]], most: int) -> tuple[dict[int, tuple[int, int]], list[tuple[np.ndarray, np.ndarray]]]:
    """The first block and the number of blocks of each cell, and of each block its cells and their radii.

    Cells stand in a chain of near ones; those that fill no block by themselves share one.
    """
    left, chain = sorted(sizes), []
    while left:
        at = 0 if not chain else int(((index.centroids[left] - index.centroids[chain[-1]]) ** 2).sum(axis=1).argmin())
        chain.append(left.pop(at))
    of, blocks, full = {}, [], most
    for c in chain:
        n, parts = sizes[c][0], -(-sizes[c][0] // most)
        if parts > 1 or full + n > most:
            of[c], full = (len(blocks), parts), n if parts == 1 else most
            blocks += [[c] for _ in range(parts)]
        else:
            of[c], full = (len(blocks) - 1, 1), full + n
            blocks[-1].append(c)
    return of, [(np.array(b), np.array([sizes[c][1] for c in b])) for b in blocks]


def _bounded_block(shared, k: int, apart: bool):
    """Of a block's queries (query_id, vector, limit) the records that may be among the k best of all, with the bounds of their cosine."""
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())

    def run(queries: pa.Table, records: pa.Table) -> pa.Table:
        best, x = [], shared.value
        dims = x.centroids.shape[1]
        if len(queries) and len(records):
            own, twin, cell = (records.column(n).to_numpy() for n in ("record_id", "twin", "cell"))
            order = np.lexsort((own, twin))
            start = np.flatnonzero(np.append(True, twin[order][1:] != twin[order][:-1]))
            place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
            order = np.sort(order[place < k + apart])  # of equal vectors the lowest ids are all that can count
            code = np.frombuffer(b"".join(records.column("code").to_pylist()), np.uint8).reshape(-1, dims)[order]
            own, cell, wrong = own[order], cell[order], records.column("wrong").to_numpy()[order] + SLACK
            right = (x.centroids[cell] + x.low + code * x.step).astype(np.float32)
            asked, limit = queries.column("query_id").to_numpy(), queries.column("limit").to_numpy()
            left = np.frombuffer(b"".join(queries.column("vector").to_pylist()), np.float32).reshape(-1, dims)
            for a in range(0, len(asked), 64):
                scores = (left[a : a + 64] @ right.T).astype(np.float64)
                if apart:
                    scores[asked[a : a + 64, None] == own] = -np.inf
                least = scores - wrong
                for i, row in enumerate(scores):
                    low = limit[a + i] if len(row) < k else max(limit[a + i], np.partition(least[i], len(row) - k)[len(row) - k])
                    at = np.flatnonzero((row + wrong >= low) & (row > -np.inf))
                    best.append((np.full(len(at), asked[a + i]), own[at], least[i, at], row[at] + wrong[at]))
        columns = [np.concatenate(c) for c in zip(*best, strict=True)] if best else [np.zeros(0)] * 4
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "record_id", "least", "most"), (c.astype(t.to_pandas_dtype()) for c, t in zip(columns, kinds, strict=True)), kinds, strict=True)})

    return run


def _sent(asked: DataFrame, index: VectorIndex, blocks: list[tuple[np.ndarray, np.ndarray]], first: bool) -> DataFrame:
    """(query_id, vector, limit, block): a row for the block of each query's nearest cell, or for every block that can reach its limit."""
    dims, shared = index.centroids.shape[1], asked.sparkSession.sparkContext.broadcast((index, blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, own = shared.value
        for b in (whole.slice(i, AT_ONCE) for whole in batches for i in range(0, len(whole), AT_ONCE)):
            rows = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(-1, dims)
            near = rows @ x.centroids.T
            # a vector's cosine is at most its centroid's product and the distance between the two
            reach = np.stack([(near[:, c] + (0 if first else r)).max(axis=1) for c, r in own], axis=1) + SLACK
            at, block = np.nonzero(reach == reach.max(axis=1, keepdims=True)) if first else np.nonzero(reach >= b.column(2).to_numpy()[:, None])
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in b.columns), pa.array(block.astype(np.int32))], names=["query_id", "vector", "limit", "block"])

    return asked.mapInArrow(run, "query_id long, vector binary, limit double, block int")


def exact(queries: DataFrame, records: DataFrame, k: int, index: VectorIndex | None = None, digits: int = 6, dims: int = 64, apart: bool = True, record_rows: int = RECORD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, record_id, score, rank) as of comparing all pairs: the k records of highest cosine, rounded; ties go to the lower id.

    Every code says how far it is from its vector, so codes bound a cosine from both sides. The block
    of its nearest cell gives a query a limit that its k-th best reaches; other blocks are read only
    where a cell's radius allows for that limit; records whose upper bound reaches the k-th lower
    bound are compared as they are. Of equal vectors in a block the k lowest ids go on. On vectors
    without clusters all blocks are read. Rows and ids as of `nearest`; digits are 5 at least.
    """
    index = index or build(records, k, 1.0, dims=dims)
    coded = held(bounded_codes(records, index))
    sizes = {r["cell"]: (r["n"], r["far"]) for r in coded.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # a row for each of at most MOST_CELLS cells
    q = queries.where(F.size("vector") == dims).select(F.col("query_id").cast("long").alias("query_id"), "vector")
    r = records.where(F.size("vector") == dims).select(F.col("record_id").cast("long").alias("record_id"), "vector")
    if not sizes:
        return q.join(r, F.lit(False)).select("query_id", "record_id", F.lit(0.0).alias("score"), F.lit(1).alias("rank"))
    of, blocks = _blocks_of(index, sizes, record_rows)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in unit(b.column(1), dims).astype(np.float32)], pa.binary())], names=["query_id", "vector"])

    asked = held(q.select("query_id", F.col("vector").cast("array<double>")).mapInArrow(packed, "query_id long, vector binary"))
    parts = -(-asked.count() // query_rows) or 1
    cells = coded.sparkSession.createDataFrame([(c, *b) for c, b in of.items()], "cell int, _block int, _n int")
    coded = coded.join(F.broadcast(cells), "cell").withColumn("block", (F.col("_block") + F.pmod(F.xxhash64("record_id"), F.col("_n"))).cast("int"))
    own = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part")
    coded = coded.select("record_id", "cell", "code", "wrong", "twin", "block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    kernel = _bounded_block(asked.sparkSession.sparkContext.broadcast(index), k, apart)

    def found(sent: DataFrame) -> DataFrame:
        blocks = sent.withColumn("part", own).groupBy("block", "part").cogroup(coded.groupBy("block", "part"))
        return blocks.applyInArrow(kernel, "query_id long, record_id long, least double, most double")

    limit = lambda rows: top_k(rows, k, score="least").groupBy("query_id").agg(F.count("*").alias("n"), F.min("least").alias("limit")).where(F.col("n") >= k).select("query_id", "limit")
    asked = asked.withColumn("limit", F.lit(-2.0))
    if len(blocks) > 1:
        reached = limit(found(_sent(asked, index, blocks, True)))
        asked = asked.drop("limit").join(reached, "query_id", "left").select("query_id", "vector", F.coalesce("limit", F.lit(-2.0)).alias("limit"))
    rows = held(found(_sent(asked, index, blocks, False)))
    near = rows.join(limit(rows), "query_id", "left").where("limit is null or most >= limit").select("query_id", "record_id")
    scored = near.join(q.withColumnRenamed("vector", "_q"), "query_id").join(r.withColumnRenamed("vector", "_r"), "record_id")
    return top_k(scored.select("query_id", "record_id", F.round(V.cosine(F.col("_q"), F.col("_r")), digits).alias("score")), k)
