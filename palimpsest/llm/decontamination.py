"""Finding benchmark items in texts by SimHash windows and a multi-index over Hamming blocks.

For an item of L words every window of L words of a text is fingerprinted with SimHash over
its word shingles (the whole text, where it is shorter). The items' fingerprints are cut into
blocks; two fingerprints within the radius differ by at most radius // blocks bits in one
block, so a table of near values for each block yields every item within the radius. What it
yields is compared by the weighted Jaccard similarity of the shingles, each weighing as often
as it occurs. A window that has no shingle of any item of its size has similarity 0 with all
of them and isn't fingerprinted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import tidy
from .words import Words, run_hashes, words_of

SHINGLE_WORDS, THRESHOLD = 5, 0.75
#: Bits that may differ. A similarity of 0.75 is an expected distance of about 11 of 64, with a
#: standard deviation of 3.
RADIUS, BLOCKS = 24, 8
#: Items that are sent to the executors at once; more are taken in rounds, each over all texts.
MOST_ITEMS = 20_000

_POPCOUNT = np.array([bin(x).count("1") for x in range(256)], dtype=np.uint8)


@dataclass
class SizeIndex:
    """The items of one number of words."""

    words: int
    width: int  # shingles of an item
    items: list[int]
    bags: list[Counter]
    shingles: np.ndarray  # sorted
    prints: np.ndarray  # items x 8 bytes
    near: np.ndarray  # block x byte value x items: within the block's share of the radius


def fingerprints(shingles: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """SimHash of the `width` shingles from each start on, as 8 bytes each."""
    if not len(starts):
        return np.zeros((0, 8), np.uint8)
    need = np.zeros(len(shingles) + 1, dtype=np.int32)
    np.add.at(need, starts, 1)
    np.add.at(need, starts + width, -1)
    used = np.flatnonzero(np.cumsum(need[:-1]) > 0)
    place = np.full(len(shingles) + 1, -1, dtype=np.int64)
    place[used] = np.arange(len(used))
    bits = np.unpackbits(np.ascontiguousarray(shingles[used]).view(np.uint8).reshape(-1, 8), axis=1)
    out = np.empty((len(starts), 8), np.uint8)
    sums = np.zeros((len(used) + 1, 64), dtype=np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=sums[1:])
    first = place[starts]
    out[:] = np.packbits(2 * (sums[first + width] - sums[first]) > width, axis=1)
    return out


def build_index(items: list[tuple[int, str]], k: int = SHINGLE_WORDS, radius: int = RADIUS) -> list[SizeIndex]:
    """Items by size; those without words are left out."""
    by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
    if items:
        for words in words_of(pa.array([t for _, t in items], pa.string()), lower=True):
            bounds = words.bounds
            for i in range(words.n_rows):
                own = words.hashes[bounds[i] : bounds[i + 1]]
                if len(own):
                    by_size.setdefault(len(own), []).append((items[words.first + i][0], run_hashes(own, min(k, len(own)))))
    out = []
    distance = _POPCOUNT[np.arange(256)[:, None] ^ np.arange(256)[None, :]]
    for size, own in sorted(by_size.items()):
        width = max(1, size - k + 1)
        prints = np.concatenate([fingerprints(h, np.zeros(1, np.int64), width) for _, h in own])
        near = np.stack([distance[:, prints[:, b]] <= radius // BLOCKS for b in range(BLOCKS)])
        bags = [Counter(h.tolist()) for _, h in own]
        out.append(SizeIndex(size, width, [i for i, _ in own], bags, np.unique(np.concatenate([h for _, h in own])), prints, near))
    return out


def _has(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def _similarity(bag: Counter, other: Counter) -> float:
    low = sum((bag & other).values())
    return low / (sum(bag.values()) + sum(other.values()) - low)


def matches(words: Words, index: list[SizeIndex], k: int = SHINGLE_WORDS, radius: int = RADIUS, threshold: float = THRESHOLD) -> dict[tuple[int, int], tuple[float, int, int]]:
    """(row, item) to (similarity, first word, words) of the best window, the first among equals."""
    found: dict[tuple[int, int], tuple[float, int, int]] = {}
    bounds, row = words.bounds, words.row
    counts = np.diff(bounds)
    for kk in sorted({min(k, s.words) for s in index}):
        shingles = run_hashes(words.hashes, kk)
        if not len(shingles):
            continue
        inside = row[: len(shingles)] == row[kk - 1 :]
        sizes = [s for s in index if min(k, s.words) == kk]
        every = np.unique(np.concatenate([s.shingles for s in sizes]))
        seeds = np.flatnonzero(inside)
        seeds = seeds[_has(shingles[seeds], every)]
        if not len(seeds):
            continue
        for s in sizes:
            own = seeds[_has(shingles[seeds], s.shingles)]
            if not len(own):
                continue
            r = row[own]
            # texts of the item's size and more
            big = counts[r] >= s.words
            p, q = own[big], r[big]
            mark = np.zeros(len(row) + 1, dtype=np.int32)
            np.add.at(mark, np.maximum(bounds[q], p - s.width + 1), 1)
            np.add.at(mark, np.minimum(p, bounds[q + 1] - s.words) + 1, -1)
            groups = [(np.flatnonzero(np.cumsum(mark[:-1]) > 0), s.width)]
            # shorter texts are one window each
            for i in np.unique(r[~big]):
                groups.append((np.array([bounds[i]]), int(max(1, counts[i] - k + 1))))
            for starts, width in groups:
                if not len(starts):
                    continue
                prints = fingerprints(shingles, starts, width)
                near = s.near[0][prints[:, 0]]
                for b in range(1, BLOCKS):
                    near = near | s.near[b][prints[:, b]]
                w, j = np.nonzero(near)
                close = _POPCOUNT[prints[w] ^ s.prints[j]].sum(axis=1) <= radius
                for a, b in zip(w[close].tolist(), j[close].tolist(), strict=True):
                    at = int(starts[a])
                    x = _similarity(Counter(shingles[at : at + width].tolist()), s.bags[b])
                    if x >= threshold:
                        i = int(row[at])
                        key, new = (i, s.items[b]), (x, at - int(bounds[i]), min(s.words, int(counts[i])))
                        if key not in found or x > found[key][0]:
                            found[key] = new
    return found


def _collected(items: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple[int, str]]]:
    """The items in rounds of at most `most`, ordered by id."""
    known = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    known = known.distinct()
    n = known.count()
    rounds = max(1, -(-n // max(1, most // 2)))
    for x in range(rounds if n else 0):
        part = known if rounds == 1 else known.where(F.pmod(F.xxhash64("i", "t"), F.lit(rounds)) == x)
        yield [(r.i, r.t) for r in part.orderBy("i", "t").collect()]


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
               item_text_col: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS, most_items: int = MOST_ITEMS) -> DataFrame:
    """(id, item_id, similarity, first_word, n_words): each item that a text holds, by its best window.

    Words are split at white space, A-Z folded. A row of docs gives a row for each item it
    holds; null and empty texts hold none, and null or empty items are found nowhere. Items of
    fewer than five words are one shingle. Rows may repeat an id or have none. Texts are
    searched whole; other columns aren't read; empty tables give an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    kinds = "id long, item_id long, similarity double, first_word long, n_words long"
    out = None
    for part in _collected(items, item_id_col, item_text_col, most_items):
        found = rows.mapInArrow(tidy(_rows(docs.sparkSession.sparkContext.broadcast(build_index(part, radius=radius)), radius, threshold)), kinds)
        out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], kinds) if out is None else out


def _rows(shared, radius: int, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for words in words_of(batch.column(1), lower=True):
                found = matches(words, index, radius=radius, threshold=threshold)
                if found:
                    keys = sorted(found)
                    ids = batch.column(0).take(pa.array([words.first + i for i, _ in keys]))
                    cols = list(zip(*(found[x] for x in keys), strict=True))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([j for _, j in keys], pa.int64()), pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["id", "item_id", "similarity", "first_word", "n_words"])

    return run


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
                  threshold: float = THRESHOLD, radius: int = RADIUS, most_items: int = MOST_ITEMS) -> DataFrame:
    """The rows of docs whose text holds no item, with all their columns; nothing moves."""
    at = docs.columns.index(text_col)
    for part in _collected(items, item_id_col, item_text_col, most_items):
        docs = docs.mapInArrow(tidy(_clean(docs.sparkSession.sparkContext.broadcast(build_index(part, radius=radius)), at, radius, threshold)), docs.schema)
    return docs


def _clean(shared, at: int, radius: int, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            keep = np.ones(len(batch), dtype=bool)
            for words in words_of(batch.column(at), lower=True):
                for i, _ in matches(words, index, radius=radius, threshold=threshold):
                    keep[words.first + i] = False
            yield batch if keep.all() else batch.filter(pa.array(keep))

    return run
