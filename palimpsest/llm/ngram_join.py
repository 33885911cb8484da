"""N-gram Jaccard join by count vectors in an R-tree.

Every text is the set of its distinct word shingles. Two texts link when their sets'
Jaccard similarity reaches a threshold. Texts with the same set form one class; the join
works on one text of each class.

1. Blocks. With shingles in one global order (very frequent ones last, then by hash), two
   sets of similarity >= t share a shingle among the first n - ceil(t n) + 1 of each. Texts
   that share such a shingle form a block; blocks with the same members count once.
2. Count vectors. The shingles are hashed into groups and the numbers by group are a point.
   Two sets share at most the sum of coordinate minima. In each block an R-tree over the
   points is searched with that bound; pairs that it leaves are bounded once more with the
   vectors of more groups.
3. Verification. Surviving pairs are compared by their whole sets.

Texts in large groups of near copies aren't expanded into all pairs. A first round verifies
for each text of a block its best partner and the block's most central text, and finds the
connected components; a text is marked in each block where it has candidates besides those.
The second round takes the marked texts and all members of blocks that are split, and verifies
every surviving pair whose ends are still in different components. So no link between
components is lost, and links within one aren't listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import cut, tidy
from .cluster import table as _table
from .components import components
from .words import mix, shingles_of, words_of

#: Words of a shingle, and the similarity in hundredths.
SHINGLE_WORDS, THRESHOLD = 5, 75
#: Dimensions of the tree's points; leaves compare vectors of about n / COARSE groups, and pairs
#: those of about n / FINE groups.
DIMS, COARSE, FINE = 32, 8, 2
#: Ids that are broadcast at most; a longer list is joined with a shuffle.
BROADCAST_IDS = 1_000_000
#: Members of a tree node.
FANOUT = 16
#: A block with more members is split into chunks, of which each pair becomes a block.
BLOCK_ROWS = 20_000
#: Blocks of a text, by name, that say whether an earlier block has a pair already. Further ones
#: only cost repeated pairs.
NAMES = 32
#: A shingle in this share of a batch's texts is reported as frequent, and that many of the
#: most frequent ones go last in the order. Only the cost depends on either.
FREQUENT_SHARE, FREQUENT_MOST = 0.005, 20_000


def n_groups(n: int, per: int) -> int:
    """Groups of the vector of a set of n shingles, about `per` shingles each: a power of two."""
    return max(DIMS, 1 << max(0, int(n) // per - 1).bit_length())


def count_vector(hashes: np.ndarray, per: int) -> np.ndarray:
    """Numbers of shingles by group; folding halves gives the vector of fewer groups."""
    g = n_groups(len(hashes), per)
    counts = np.bincount((hashes >> np.uint64(20)).astype(np.int64) & (g - 1), minlength=g)
    return counts.astype(np.uint8 if counts.max() < 256 else np.uint32)


def vector_of(data: bytes, n: int, per: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8 if len(data) == n_groups(n, per) else np.uint32)


def fold(vector: np.ndarray, g: int) -> np.ndarray:
    return vector.reshape(-1, g).sum(axis=0, dtype=np.int64) if len(vector) > g else vector.astype(np.int64)


class CountTree:
    """An R-tree over count vectors, packed in the order of set size, then coordinates."""

    def __init__(self, sizes: np.ndarray, points: np.ndarray):
        self.sizes, self.points = sizes, points
        self.order = np.lexsort((points[:, 1], points[:, 0], sizes))
        top, least, most = points[self.order], sizes[self.order], sizes[self.order]
        self.levels = []
        while True:
            at = np.arange(0, len(top), FANOUT)
            top = np.maximum.reduceat(top, at, axis=0)
            least, most = np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
            self.levels.append((top, least, most))
            if len(at) == 1:
                break

    def search(self, size: int, point: np.ndarray, t: int) -> np.ndarray:
        """Members whose size fits and whose summed minima reach the least overlap."""
        at = np.zeros(1, dtype=np.int64)
        for top, least, most in reversed(self.levels):
            at = at[at < len(top)]
            fit = (100 * most[at] >= t * size) & (t * least[at] <= 100 * size)
            at = at[fit]
            bound = np.minimum(top[at], point).sum(axis=1)
            at = at[(100 + t) * bound >= t * (size + np.minimum(least[at], size * 2))]
            at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        at = self.order[at[at < len(self.order)]]
        n = self.sizes[at]
        at = at[(100 * n >= t * size) & (t * n <= 100 * size)]
        bound = np.minimum(self.points[at], point).sum(axis=1)
        return at[(100 + t) * bound >= t * (self.sizes[at] + size)]


def _profile(lower: bool, k: int):
    """Rows of each text, and of the shingles that are frequent in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, seen = batch.column(0), []
            for words in words_of(batch.column(1), lower):
                rows, hashes = shingles_of(words, k)
                cuts = np.searchsorted(rows, np.arange(words.n_rows + 1))
                spread = mix(hashes + np.uint64(0x5851F42D4C957F2D))
                one, two, fine, coarse = [], [], [], []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    one.append(int(hashes[a:b].sum(dtype=np.uint64)))
                    two.append(int(np.bitwise_xor.reduce(spread[a:b])) if b > a else 0)
                    fine.append(count_vector(hashes[a:b], FINE).tobytes() if b > a else b"")
                    coarse.append(count_vector(hashes[a:b], COARSE).tobytes() if b > a else b"")
                seen.append(hashes)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(words.first, words.n_rows), pa.array(np.diff(cuts), pa.int64()),
                    pa.array(np.array(one, np.uint64).view(np.int64)), pa.array(np.array(two, np.uint64).view(np.int64)),
                    pa.array(fine, pa.binary()), pa.array(coarse, pa.binary()), pa.nulls(words.n_rows, pa.int64()),
                ], names=["id", "n", "k1", "k2", "fine", "coarse", "shingle"])
            if seen:
                found, count = np.unique(np.concatenate(seen), return_counts=True)
                often = count >= max(8, FREQUENT_SHARE * len(batch))
                m = int(often.sum())
                yield pa.RecordBatch.from_arrays([
                    pa.nulls(m, pa.int64()), pa.array(count[often], pa.int64()), pa.nulls(m, pa.int64()),
                    pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.array(found[often].view(np.int64)),
                ], names=["id", "n", "k1", "k2", "fine", "coarse", "shingle"])

    return run


def _prefixes(lower: bool, k: int, t: int, last: np.ndarray):
    """(id, the shingles by which a text is put into blocks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for words in words_of(batch.column(1), lower):
                rows, hashes = shingles_of(words, k)
                cuts = np.searchsorted(rows, np.arange(words.n_rows + 1))
                often = np.isin(hashes, last, kind="sort") if len(last) else np.zeros(len(hashes), bool)
                lists = []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    n = int(b - a)
                    m = n - (-(-t * n // 100)) + 1 if n else 0
                    h, o = hashes[a:b], often[a:b]
                    lists.append((np.concatenate([h[~o], h[o]]) if o.any() else h)[:m].view(np.int64))
                flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
                offs = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(words.first, words.n_rows), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))], names=["id", "shingles"]
                )

    return run


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole groups of equal, adjacent keys; several groups in one table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        if len(change):
            last = int(change[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, size, id) of blocks of two members or more; a block's name is the hash of its members."""
    seen: set[int] = set()
    for table in _runs(batches, "shingle"):
        keys, ids = table.column("shingle").to_numpy(), table.column("id").to_numpy()
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.append(start, len(keys)))
        name = np.add.reduceat(mix(ids.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), start)
        name = mix(name + size.astype(np.uint64)).view(np.int64)
        first = np.zeros(len(start), dtype=bool)
        for i in np.flatnonzero(size > 1):
            first[i] = int(name[i]) not in seen
            seen.add(int(name[i]))
        if len(seen) > 2_000_000:
            seen.clear()
        take = np.repeat(first, size)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x, size)[take]) for x in (name, size)] + [pa.array(ids[take])], names=["block", "size", "id"])


def _search(t: int, first_round: bool):
    """Pairs (u, v), u < v, of each block that the summed minima leave.

    The first round takes coarse vectors and pairs each member with its best partner and with
    the block's centre; the second takes fine ones and all pairs of different components.
    Rows with a block are marks of the first round: u has candidates there that aren't paired.
    A candidate pair that is not told is marked at both ends, as the bound is symmetric.
    """
    per = COARSE if first_round else FINE

    def pairs(ids: np.ndarray, sizes: np.ndarray, fine: list[np.ndarray], group: np.ndarray, side: np.ndarray, names: list[frozenset], own: int) -> tuple[set[tuple[int, int]], list[int]]:
        points = np.array([fold(v, DIMS) for v in fine])
        found: set[tuple[int, int]] = set()
        marked: list[int] = []
        tree = CountTree(sizes, points)
        folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def bound(i: int, at: np.ndarray) -> np.ndarray:
            """Summed minima of the vectors, folded to the fewer groups of the two."""
            out = np.zeros(len(at), dtype=np.int64)
            g = np.minimum(len(fine[i]), lengths[at])
            for x in np.unique(g):
                if x not in folded:
                    own = np.flatnonzero(lengths >= x)
                    place = np.full(len(ids), -1)
                    place[own] = np.arange(len(own))
                    folded[x] = (place, np.array([fold(fine[j], int(x)) for j in own]))
                place, m = folded[x]
                out[g == x] = np.minimum(m[place[at[g == x]]], m[place[i]]).sum(axis=1)
            return out

        lengths = np.array([len(v) for v in fine])
        centre = None
        if first_round and len(ids) > 3:
            centre = int(np.argmin(np.abs(points - points.mean(axis=0)).sum(axis=1)))
        for i in range(len(ids)):
            at = tree.search(int(sizes[i]), points[i], t)
            at = at[ids[at] != ids[i]] if first_round else at[(ids[at] > ids[i]) & (group[at] != group[i])]
            if side is not None:
                at = at[side[at] != side[i]]
            if not len(at):
                continue
            shared = bound(i, at)
            ok = (100 + t) * shared >= t * (sizes[at] + sizes[i])
            at, shared = at[ok], shared[ok]
            if first_round and len(at):
                best = int(at[np.argmax(shared / (sizes[at] + sizes[i]))])
                chosen = [best, centre] if centre is not None and centre in at else [best]
                if len(at) > len(set(chosen)):
                    marked.append(int(ids[i]))
            else:
                chosen = [j for j in at if not any(x < own for x in names[i] & names[j])]
            found.update((min(int(ids[i]), int(ids[j])), max(int(ids[i]), int(ids[j]))) for j in chosen)
        return found, marked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[int, int]] = set()
        for table in _runs(batches, "block"):
            keys, ids = table.column("block").to_numpy(), table.column("id").to_numpy()
            sizes, group, chunk = (table.column(c).to_numpy() for c in ("n", "component", "chunk"))
            vectors, names, own = (table.column(c).to_pylist() for c in ("vector", "names", "name"))
            start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            new: set[tuple[int, int]] = set()
            marks: list[tuple[int, int]] = []
            for a, b in zip(start, np.append(start[1:], len(keys)), strict=True):
                if b - a < 2:
                    continue
                fine = [vector_of(v, n, per) for v, n in zip(vectors[a:b], sizes[a:b].tolist(), strict=True)]
                two = chunk[a:b].min() != chunk[a:b].max()
                found, marked = pairs(ids[a:b], sizes[a:b], fine, group[a:b], chunk[a:b] if two else None, [frozenset(x) for x in names[a:b]], own[a])
                new |= found
                marks += [(i, own[a]) for i in marked]
            new -= told
            told |= new
            if len(told) > 2_000_000:
                told.clear()
            both = np.array(sorted(new), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.nulls(len(both), pa.int64())], names=["u", "v", "block"])
            if marks:
                at = np.array(marks, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.nulls(len(at), pa.int64()), pa.array(at[:, 1])], names=["u", "v", "block"])

    return run


def _split(members: DataFrame, first_round: bool, block_rows: int) -> DataFrame:
    """Blocks beyond block_rows in chunks: each alone in the first round, else each pair of them."""
    sized = members.groupBy("block").count().where(F.col("count") > block_rows)
    parts = F.coalesce(F.ceil(F.col("count") / block_rows), F.lit(1)).cast("int")
    out = members.join(sized, "block", "left").withColumn("parts", parts)
    out = out.withColumn("chunk", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("id"), F.col("parts"))).otherwise(F.lit(0)).cast("long"))
    if first_round:
        out = out.withColumn("block", F.when(F.col("parts") > 1, F.xxhash64("block", "chunk")).otherwise(F.col("block")))
        return out.withColumn("chunk", F.lit(0).cast("long")).drop("count", "parts")
    other = F.explode(F.when(F.col("parts") > 1, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.lit(0))))
    out = out.withColumn("other", other)
    name = F.xxhash64("block", F.least("chunk", "other"), F.greatest("chunk", "other"))
    return out.withColumn("block", F.when(F.col("parts") > 1, name).otherwise(F.col("block"))).drop("count", "parts", "other")


def _refine(t: int):
    """(u, v) of pairs whose fine vectors leave them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, n, m = (batch.column(c).to_numpy() for c in ("u", "v", "n", "m"))
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            groups = np.minimum([n_groups(x, FINE) for x in n], [n_groups(x, FINE) for x in m]) if len(batch) else n
            shared = np.zeros(len(batch), dtype=np.int64)
            for g in np.unique(groups):
                at = np.flatnonzero(groups == g)
                left = np.array([fold(vector_of(a[i], n[i], FINE), int(g)) for i in at])
                right = np.array([fold(vector_of(b[i], m[i], FINE), int(g)) for i in at])
                shared[at] = np.minimum(left, right).sum(axis=1)
            ok = (100 + t) * shared >= t * (n + m)
            yield pa.RecordBatch.from_arrays([pa.array(u[ok]), pa.array(v[ok])], names=["u", "v"])

    return run


def _linked(lower: bool, k: int, t: int):
    """(u, v) of pairs of texts (a, b) whose whole sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for c in ("a", "b"):
                own = []
                for words in words_of(batch.column(c), lower):
                    rows, hashes = shingles_of(words, k)
                    own += np.split(hashes, np.searchsorted(rows, np.arange(1, words.n_rows)))
                sets.append(own)
            ok = np.zeros(len(batch), dtype=bool)
            for i, (a, b) in enumerate(zip(*sets, strict=True)):
                shared = len(np.intersect1d(a, b, assume_unique=True))
                ok[i] = 100 * shared >= t * (len(a) + len(b) - shared)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(ok))

    return run


def _both(pairs: DataFrame, table: DataFrame, *columns: tuple[str, str, str]) -> DataFrame:
    """pairs (u, v) with columns of table (id, ...): (column, its name for u, its name for v)."""
    for end, place in (("u", 1), ("v", 2)):
        pairs = pairs.join(table.select(F.col("id").alias(end), *(F.col(c[0]).alias(c[place]) for c in columns)), end)
    return pairs


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS,
                     threshold: int = THRESHOLD, lower: bool = True, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, n_shingles, class_id, component_id), one row for each row of docs.

    id_col must be a long. Null and empty texts have no shingles and are their own class and
    component. class_id is the least id with the same shingle set, component_id the least id
    reachable by links. Rows that repeat an id give repeated rows; rows with a null id are
    kept, each with null class and component. Other columns are not read. An empty table gives
    an empty result. Texts of any length are taken whole.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    kinds = "id long, n long, k1 long, k2 long, fine binary, coarse binary, shingle long"
    profile = _table(texts.mapInArrow(tidy(_profile(lower, k)), kinds), "profile")
    often = profile.where("shingle is not null").groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle")
    last = np.array([r.shingle for r in often.limit(FREQUENT_MOST).collect()], dtype=np.int64).view(np.uint64)
    last = np.sort(last)
    rows = profile.where("shingle is null").select("id", "n", "k1", "k2", "fine", "coarse")

    heads = cut(rows.where("id is not null and n > 0").groupBy("k1", "k2", "n").agg(F.min("id").alias("class_id")))
    ids = heads.select(F.col("class_id").alias("id"))
    prefixes = texts.mapInArrow(tidy(_prefixes(lower, k, threshold, last)), "id long, shingles array<long>")
    prefixes = prefixes.join(ids, "id", "left_semi").select(F.explode("shingles").alias("shingle"), "id")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = prefixes.repartition(parts, "shingle").sortWithinPartitions("shingle", "id")
    members = _table(dealt.mapInArrow(tidy(_blocks), "block long, size long, id long").distinct(), "members")
    points = rows.dropDuplicates(["id"])

    def search(members: DataFrame, first_round: bool) -> DataFrame:
        vector = F.col("coarse" if first_round else "fine").alias("vector")
        out = _split(members.drop("size").withColumn("name", F.col("block")), first_round, block_rows)
        # vectors come last, so that they are shuffled by block once
        out = out.join(points.select("id", "n", vector), "id").repartition(parts, "block").sortWithinPartitions("block", "id")
        return out.mapInArrow(tidy(_search(threshold, first_round)), "u long, v long, block long")

    def refined(pairs: DataFrame) -> DataFrame:
        near = _both(pairs.distinct(), points, ("n", "n", "m"), ("fine", "a", "b"))
        near = near.where(f"100 * n >= {threshold} * m and {threshold} * n <= 100 * m")
        return _table(near.mapInArrow(tidy(_refine(threshold)), "u long, v long"), "pairs")

    two = members.where("size = 2").groupBy("block").agg(F.min("id").alias("u"), F.max("id").alias("v")).select("u", "v")
    large = members.where("size > 2")
    alone = large.withColumn("component", F.col("id")).withColumn("names", F.array().cast("array<long>"))
    found = _table(search(alone, True), "found")
    first = refined(two.union(found.where("block is null").select("u", "v")))

    def linked(pairs: DataFrame) -> DataFrame:
        ends = cut(pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id"))).distinct())
        few = F.broadcast(ends) if ends.count() <= BROADCAST_IDS else ends
        whole = _table(texts.join(few, "id", "left_semi").dropDuplicates(["id"]), "ends")
        return cut(_both(pairs, whole, ("text", "a", "b")).mapInArrow(tidy(_linked(lower, k, threshold)), "u long, v long"))

    links = linked(first)
    label = components(links)
    # chunks alone can't tell which members of a split block have candidates
    left = found.where("block is not null").select("block", F.col("u").alias("id"))
    left = left.union(large.where(F.col("size") > block_rows).select("block", "id")).distinct()
    left = left.join(label.select(F.col("node").alias("id"), "component"), "id", "left")
    left = cut(left.withColumn("component", F.coalesce("component", "id")))
    mixed = left.groupBy("block").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("block")
    left = left.join(mixed, "block", "left_semi")
    names = left.groupBy("id").agg(F.slice(F.sort_array(F.collect_set("block")), 1, NAMES).alias("names"))
    second = refined(search(left.join(names, "id"), False).select("u", "v")).join(first, ["u", "v"], "left_anti")
    more = linked(second)
    if more.limit(1).count():
        label = components(links.union(more))

    heads = heads.join(label.select(F.col("node").alias("class_id"), F.col("component").alias("component_id")), "class_id", "left")
    heads = heads.withColumn("component_id", F.coalesce("component_id", "class_id"))
    out = rows.drop("fine", "coarse").join(heads, ["k1", "k2", "n"], "left")
    return out.select(
        F.col("id"), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )
