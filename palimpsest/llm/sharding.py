"""Shards of near equal bytes: the minimax contiguous partition of text groups.

Rows of equal texts are an atomic group, and the groups are ordered by a hash of the text. The
smallest capacity with which a greedy scan fills at most n_shards shards is found by binary
search; the scan's cuts are the shards. The sizes of the groups stay on the executors: the
search works on runs of groups, and only runs that a cut may fall into are split further, until
the cuts lie between groups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cluster import cut

N_SHARDS, UNITS = 16, 1 << 16
#: Rows of one unit are numbered in as many parts.
SALTS = 64


def fill(sums: np.ndarray, capacity: int, most: int) -> list[int] | None:
    """Greedy ends of the shards over prefix sums, or None if `most` don't suffice."""
    ends, at, base = [], 0, 0
    while at < len(sums):
        nxt = int(np.searchsorted(sums, base + capacity, side="right"))
        if nxt == at or len(ends) == most:
            return None
        ends.append(nxt)
        at, base = nxt, int(sums[nxt - 1])
    return ends


def minimax_cuts(sizes: list[int], n_shards: int) -> list[int]:
    """Ends of at most n_shards runs of the sizes whose largest sum is the least possible."""
    if not sizes:
        return []
    sums = np.cumsum(np.array(sizes, dtype=np.int64))
    low, high = max(max(sizes), -(-int(sums[-1]) // n_shards)), int(sums[-1])
    while low < high:
        mid = (low + high) // 2
        if fill(sums, mid, n_shards) is None:
            low = mid + 1
        else:
            high = mid
    return fill(sums, low, n_shards)


def _bits(units: int) -> int:
    return max(1, (units - 1).bit_length())


@dataclass
class Cell:
    """A run of text groups: those whose hashes lie in [first, last]; one group if they are equal."""

    first: int
    last: int
    size: int


def open_cells(cells: list[Cell], n_shards: int, least: int, most: int) -> list[int]:
    """Places of cells of several groups that a cut may fall into at a capacity in [least, most].

    The ends of the shards grow with the capacity and with the place where they begin, so the
    j-th end lies between what the least capacity gives, each time ending a cell early, and what
    the largest gives, each time ending within the cell that overflows.
    """
    sums = np.concatenate([[0], np.cumsum([c.size for c in cells])])
    out: set[int] = set()
    low = high = 0
    for _ in range(n_shards):
        low = int(np.searchsorted(sums, sums[low] + least, side="right")) - 1
        high = min(len(cells), int(np.searchsorted(sums, sums[high] + most, side="right")))
        if low >= len(cells):
            break
        out.update(i for i in range(low, high) if cells[i].first != cells[i].last)
    return sorted(out)


def _cells_of(groups: DataFrame, key: Column) -> list[Cell]:
    rows = groups.groupBy(key.alias("cell")).agg(F.min("hash").alias("first"), F.max("hash").alias("last"), F.sum("size").alias("size"))
    return [Cell(r["first"], r["last"], r["size"]) for r in rows.orderBy("first").collect()]


def shard_starts(groups: DataFrame, n_shards: int, units: int = UNITS) -> list[int]:
    """The hashes at which the shards but the first begin, for groups (hash, size) in the order of hashes.

    The least capacity is found over `units` runs of groups first. Runs that a cut may fall into
    are then split, into about 2 * `units` pieces at a time, until each of them is one group, which
    makes the partition that of the groups themselves.
    """
    bits = _bits(units)
    cells = _cells_of(groups, F.shiftright("hash", 64 - bits))
    if not cells:
        return []
    total = sum(c.size for c in cells)
    least = max(-(-total // n_shards), groups.agg(F.max("size")).first()[0])
    while True:
        ends = minimax_cuts([c.size for c in cells], n_shards)
        edges = [0, *ends]
        most = max(sum(c.size for c in cells[a:b]) for a, b in zip(edges, ends, strict=False))
        split = open_cells(cells, n_shards, least, most)
        if not split or most == least:
            return [cells[e].first for e in ends[:-1]]
        each = max(1, (2 * units // len(split)).bit_length() - 1)
        spans = [(i, c.first >> (64 - bits), c.first, c.last, max(0, (c.last - c.first).bit_length() - each)) for i, c in ((i, cells[i]) for i in split)]
        spans = groups.sparkSession.createDataFrame(spans, "place int, unit long, low long, high long, shift int")
        own = groups.withColumn("unit", F.shiftright("hash", 64 - bits)).join(F.broadcast(spans), "unit").where("hash between low and high")
        fine = _cells_of(own, F.struct("place", F.expr("shiftright(hash - low, shift)").alias("piece")))
        taken = set(split)
        cells = sorted([c for i, c in enumerate(cells) if i not in taken] + fine, key=lambda c: c.first)


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = N_SHARDS, units: int = UNITS, salts: int = SALTS) -> DataFrame:
    """(id, size, text_crc32, shard, slot), a row for each row of docs, under the law of bytes.

    size is the text's UTF-8 bytes plus one; a null text has size 1 and groups with empty
    ones. Rows of equal texts are one group and stay together; the largest shard is as small as
    a contiguous partition of the groups allows. slot numbers a shard's rows from 0 without gaps,
    by hash, then by a hash of the id, the id and the size. Rows that repeat an id, or have none,
    are separate rows. One group larger than a shard fills one alone. Extra columns aren't read;
    an empty table gives an empty result. Only runs of groups come to the driver: at most
    `units` and the pieces of those at cuts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # rows without id are dealt to salts by their place in the table, which the cut then fixes
    salt = F.when(F.col(id_col).isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64(id_col))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("hash"), F.pmod(salt, F.lit(salts)).cast("int").alias("salt"),
    )
    rows = cut(rows)
    groups = cut(rows.groupBy("hash").agg(F.sum("size").alias("size")))
    starts = shard_starts(groups, n_shards, units)
    passed = F.size(F.filter(F.array(*map(F.lit, starts)), lambda x: x <= F.col("hash"))) if starts else F.lit(0)
    unit = F.shiftright("hash", 64 - _bits(units))
    rows = rows.withColumn("shard", passed.cast("int")).withColumn("unit", unit)
    before = W.partitionBy("shard").orderBy("unit", "salt").rowsBetween(W.unboundedPreceding, -1)
    parts = rows.groupBy("shard", "unit", "salt").agg(F.count("*").alias("n"))
    parts = parts.select("shard", "unit", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = W.partitionBy("shard", "unit", "salt").orderBy("hash", "id", "size", "text_crc32")
    out = rows.withColumn("within", F.row_number().over(own) - 1).join(parts, ["shard", "unit", "salt"])
    return out.select("id", "size", "text_crc32", "shard", (F.col("first") + F.col("within")).cast("long").alias("slot"))
