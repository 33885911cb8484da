"""Hashed n-gram indicators of texts, for the classifiers, and the labelled sample they fit on.

A feature is a bucket of 2**BITS; a text either has it or not. All texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import tidy
from .words import Words, mix, powers, words_of

BITS = 20
#: Byte lengths of word beginnings that are features of their own.
BEGINNINGS = (4, 5, 6, 7, 8)

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 0x80)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_SOLID = _UPPER | _LOWER | _DIGIT
_FOLDED = (_BYTES + 1).astype(np.uint64)
_FOLDED[65:91] = _FOLDED[97:123]


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    return (mix(h + np.uint64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(64 - BITS)).astype(np.int64)


def _inner(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words without the punctuation around them; equal if nothing is left."""
    n = len(words.data)
    solid = _SOLID[words.data]
    at = np.arange(n)
    last = np.maximum.accumulate(np.where(solid, at, -1)) if n else at
    following = np.minimum.accumulate(np.where(solid, at, n)[::-1])[::-1] if n else at
    start = np.minimum(following[words.starts], words.ends)
    end = np.maximum(last[words.ends - 1] + 1, start)
    return start, end


def _fold_sums(words: Words) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = powers(len(words.data))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_FOLDED[words.data] * power[: len(words.data)], dtype=np.uint64)])
    return sums, inverse


def word_features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of words without punctuation, A-Z folded, and of their beginnings."""
    start, end = _inner(words)
    keep = end > start
    start, end, row = start[keep], end[keep], words.row[keep]
    sums, inverse = _fold_sums(words)
    hashed = lambda s, e: (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)
    rows, buckets = [row], [_bucket(hashed(start, end), 1)]
    for size in BEGINNINGS:
        long = end - start > size
        rows.append(row[long])
        buckets.append(_bucket(hashed(start[long], start[long] + size), 2))
    return np.concatenate(rows), np.concatenate(buckets)


def shape_features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of runs of one to four word shapes, of words, and of pairs of words.

    A shape has a word's case, the punctuation at its ends, a class of its length, and whether
    it repeats the word before it.
    """
    data, row = words.data, words.row
    count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags[data])])[np.stack([words.starts, words.ends])], axis=0)[0]
    if not len(row):
        return row, row
    upper, lower, digit = count(_UPPER), count(_LOWER & (_BYTES < 0x80)), count(_DIGIT)
    case = np.select([digit > 0, (upper > 0) & (lower == 0), (upper > 0) & _UPPER[data[words.starts]], upper > 0, lower > 0], [1, 2, 3, 4, 5], 0)
    mark = lambda at: np.where(_SOLID[data[at]], 0, data[at].astype(np.int64))
    size = np.minimum(np.log2(words.ends - words.starts).astype(np.int64), 5)
    same = np.concatenate([[False], (words.hashes[1:] == words.hashes[:-1]) & (row[1:] == row[:-1])])
    shape = ((((case * 256 + mark(words.starts)) * 256 + mark(words.ends - 1)) * 8) * 2 + same).astype(np.uint64)
    rows, buckets = [row], [_bucket(shape * np.uint64(8) + size.astype(np.uint64), 3)]
    run = shape
    for n in (1, 2, 3, 4):
        if n > 1:
            run = mix(run[:-1] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) + shape[n - 1 :]
        inside = row[: len(run)] == row[n - 1 :]
        rows.append(row[: len(run)][inside])
        buckets.append(_bucket(run[inside], 3 + n))
    start, end = _inner(words)
    sums, inverse = _fold_sums(words)
    h = (sums[end] - sums[start]) * inverse[start]
    pair = mix(h[:-1]) * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    inside = row[:-1] == row[1:]
    return np.concatenate([*rows, row, row[:-1][inside]]), np.concatenate([*buckets, _bucket(h, 8), _bucket(pair[inside], 9)])


Features = Callable[[Words], tuple[np.ndarray, np.ndarray]]


def distinct(row: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(row << BITS | bucket)
    return key >> BITS, key & ((1 << BITS) - 1)


def of_text(text: str, features: Features) -> np.ndarray:
    """Sorted buckets of one text."""
    words = next(words_of(pa.array([text], pa.string())))
    return distinct(*features(words))[1]


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, trains: Callable, most: int) -> DataFrame:
    """At most `most` rows (_id, _label, _text) that `trains` (of the id as text) accepts.

    Taken in the order of a hash of the id, so the sample doesn't depend on the table's layout.
    Labels of one id are averaged and rounded; rows with null labels or texts are left out. The
    ids that are broadcast and the rows are bounded by `most`.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(trains(F.col(id_col).cast("string")))
    known = known.groupBy(F.col(id_col).alias("_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("_label"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text is not null").join(F.broadcast(known), "_id")
    return rows.select("_id", "_label", "_text").dropDuplicates(["_id"])


def feature_rows(rows: DataFrame, features: Features, pairs_of: Callable[[str], list[tuple[str, str]]] | None = None) -> DataFrame:
    """(id, label, buckets, other) of the sample's rows, and of the pairs of texts that pairs_of makes of them.

    Of a pair, label is null and buckets and other are the sorted buckets of its texts; of a row,
    other is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (("id", pa.int64()), ("label", pa.int32()), ("buckets", pa.list_(pa.int32())), ("other", pa.list_(pa.int32())))
        for batch in batches:
            for words in words_of(batch.column(2)):
                row, bucket = distinct(*features(words))
                offs = np.searchsorted(row, np.arange(words.n_rows + 1)).astype(np.int32)
                own = pa.ListArray.from_arrays(pa.array(offs), pa.array(bucket.astype(np.int32)))
                ids, labels = (batch.column(x).slice(words.first, words.n_rows) for x in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, labels.cast(pa.int32()), own, pa.nulls(words.n_rows, kinds[3][1])], names=[n for n, _ in kinds])
            for key, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True) if pairs_of else ():
                found = [(of_text(a, features), of_text(b, features)) for a, b in pairs_of(text)]
                if found:
                    left, right = zip(*found, strict=True)
                    columns = [[key] * len(found), [None] * len(found), left, right]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])

    return rows.select(F.col("_id").cast("long"), "_label", "_text").mapInArrow(tidy(run), "id long, label int, buckets array<int>, other array<int>")


def _lists(lists: pa.ListArray) -> list[np.ndarray]:
    """The lists as views of their values; nulls are empty."""
    flat, offs = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)]


def fit_apart(rows: DataFrame, fit: Callable[[list[tuple[int, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]], dict]) -> dict:
    """What fit makes of the feature_rows: labelled rows in the order of ids, and pairs.

    fit runs in one task, as the sample is bounded, so that neither the sample nor the fitting is
    the driver's; only the model comes back. fit returns numbers and one array `weights` over the
    buckets, of which those other than 0 are sent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, pairs = [], []
        for batch in batches:
            keys, labels, first, second = batch.column(0).to_pylist(), batch.column(1).to_pylist(), _lists(batch.column(2)), None
            for i, (key, label) in enumerate(zip(keys, labels, strict=True)):
                if label is None:
                    second = second or _lists(batch.column(3))
                    pairs.append((first[i], second[i]))
                else:
                    rows.append((key, label, first[i]))
        rows.sort(key=lambda r: r[0])
        labelled = [r[1:] for r in rows]
        model = fit(labelled, pairs)
        weights = model.pop("weights")
        at = np.flatnonzero(weights)
        yield pa.RecordBatch.from_pydict({
            "bucket": pa.array([at.astype(np.int32)], pa.list_(pa.int32())), "weight": pa.array([weights[at]], pa.list_(pa.float64())),
            "name": pa.array([list(model)], pa.list_(pa.string())), "number": pa.array([[float(x) for x in model.values()]], pa.list_(pa.float64())),
        })

    out = rows.repartition(1).mapInArrow(tidy(run), "bucket array<int>, weight array<double>, name array<string>, number array<double>").toArrow()
    if not len(out):  # no task ran, as there were no rows
        return fit([], [])
    weights = np.zeros(1 << BITS)
    weights[out.column("bucket")[0].values.to_numpy()] = out.column("weight")[0].values.to_numpy()
    return dict(zip(out.column("name")[0].as_py(), out.column("number")[0].as_py(), strict=True)) | {"weights": weights}


def slices(rows: list[np.ndarray], n: int = 256) -> Iterator[np.ndarray]:
    """The values of n rows at a time, so that no copy of all of them is made."""
    for i in range(0, len(rows), n):
        yield np.concatenate(rows[i : i + n])


def compact(rows: list[np.ndarray], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' buckets among the chosen, as places there: starts of each row, and the places."""
    place = np.full(1 << BITS, -1, dtype=np.int32)
    place[chosen] = np.arange(len(chosen))
    sizes = np.array([np.count_nonzero(place[r] >= 0) for r in rows], dtype=np.int64)
    kept = (place[x] for x in slices(rows))
    return np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([np.zeros(0, np.int32), *(x[x >= 0] for x in kept)])


def row_margins(words: Words, features: Features, weights: np.ndarray, bias: float, by_root: bool) -> np.ndarray:
    """Of each row the bias plus the sum of its features' weights.

    by_root divides the sum by the root of the number of its features that have a weight.
    """
    row, bucket = features(words)
    used = weights[bucket] != 0
    row, bucket = distinct(row[used], bucket[used])
    total = np.bincount(row, weights[bucket], words.n_rows)
    if by_root:
        total = total / np.sqrt(np.maximum(np.bincount(row, minlength=words.n_rows), 1))
    return total + bias


def margins(docs: DataFrame, id_col: str, text_col: str, features: Features, weights: np.ndarray, bias: float, by_root: bool = False) -> DataFrame:
    """(id, margin) of every row of docs, by row_margins; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in words_of(batch.column(1)):
                out = row_margins(words, features, shared.value, bias, by_root)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(words.first, words.n_rows), pa.array(out, pa.float64())], names=["id", "margin"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(run), "id long, margin double")
