"""Collocations: phrases of two to four words that stand together more often than their parts.

Texts are split into pieces, and equal pieces become one with a multiplicity. Phrases are counted
level by level: one of k words is looked at only where both of its parts of k - 1 words may be
frequent, by a bit array of fixed size over hashes, whose false hits cost work but change nothing.
Tasks combine their phrases and deal them by hash; in each bucket DuckDB adds the weights, within
a memory limit and on disk beyond it. Parts of candidates are looked up by requests that are
shuffled to where the part's count is.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import duckdb
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import table, tidy
from .words import mix, run_hashes, steps, utf8_of, words_of

#: Bits of the array of frequent hashes, and those of one piece of it.
BITS, CHUNK = 1 << 26, 1 << 16
#: Bytes of phrases that a task combines at a time, and what DuckDB may hold in memory.
COMBINE_BYTES, DUCKDB_MEMORY = 1 << 24, "256MB"
#: Phrases cut out of a text at a time.
STEP = 1 << 16

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SOLID = ~_BREAK
_SOLID[[0x20, 0x09]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _strings(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def split_pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """Row, words joined by single spaces, and number of words, of the pieces that have words."""
    raw, offsets = utf8_of(texts)
    for i, j in steps(offsets):
        data = _LOWER[raw[offsets[i] : offsets[j]]]
        offs = offsets[i : j + 1] - offsets[i]
        solid = _SOLID[data]
        first = np.zeros(len(data) + 1, dtype=bool)
        first[offs] = True
        begins = solid & (first[:-1] | ~np.concatenate([[False], solid[:-1]]))
        starts = np.flatnonzero(begins)
        if not len(starts):
            continue
        row = np.searchsorted(offs, starts, side="right") - 1
        piece = np.cumsum(_BREAK[data])[starts] + row  # grows with each break and each row
        heads = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
        inner = np.ones(len(starts), dtype=bool)
        inner[heads] = False
        gaps = starts[inner] - 1
        data[gaps] = 0x20
        solid[gaps] = True
        before = np.concatenate([[0], np.cumsum(solid)])
        ends = np.append(before[starts[heads]], before[-1])
        yield row[heads] + i, _strings(ends, data[solid]), np.diff(np.append(heads, len(starts)))


def pieces(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, piece, n_words, m): each distinct piece of a language with its number of occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, piece, n in split_pieces(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), piece, pa.array(n.astype(np.int64))], names=["lang", "piece", "n_words"])

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(tidy(run), "lang string, piece string, n_words long")
    return found.groupBy("lang", "piece", "n_words").agg(F.count("*").alias("m"))


def _seeds(langs: pa.Array) -> np.ndarray:
    """A hash of each row's language."""
    coded = langs.dictionary_encode()
    own = [int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in coded.dictionary.to_pylist()]
    return np.array(own, np.uint64)[coded.indices.to_numpy()] if len(langs) else np.zeros(0, np.uint64)


def _places(hashes: np.ndarray, seeds: np.ndarray, bits: int) -> np.ndarray:
    return (mix(hashes ^ seeds) % np.uint64(bits)).astype(np.int64)


def _slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The strings data[start:end]."""
    sizes = ends - starts
    offs = np.concatenate([[0], np.cumsum(sizes)])
    return _strings(offs, data[np.repeat(starts - offs[:-1], sizes) + np.arange(offs[-1])])


def _combined(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    if parts:
        whole = pa.concat_tables(parts).group_by(["lang", "phrase"]).aggregate([("n", "sum")])
        yield from whole.rename_columns(["lang", "phrase", "n"]).to_batches(max_chunksize=1 << 16)


def grams(rows: DataFrame, k: int, frequent: Broadcast | None = None) -> DataFrame:
    """(lang, phrase, n) of phrases of k words in (lang, piece, m), combined by task.

    frequent has bits for the hashes of frequent phrases of k - 1 words; one whose first or last
    k - 1 words have none is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            langs, weights, seeds = batch.column(0), batch.column(2).to_numpy(), _seeds(batch.column(0))
            for words in words_of(batch.column(1)):
                last = len(words.row) - k + 1
                if last <= 0:
                    continue
                row = words.row[:last]
                good = row == words.row[k - 1 :]
                if frequent is not None:
                    bits = frequent.value
                    h = run_hashes(words.hashes, k - 1)
                    place = _places(h, seeds[words.first + words.row[: len(h)]], len(bits) << 3)
                    known = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                    good &= known[:last] & known[1 : last + 1]
                found = np.flatnonzero(good)
                for at in (found[x : x + STEP] for x in range(0, len(found), STEP)):
                    phrase = _slices(words.data, words.starts[at], words.ends[at + k - 1])
                    own = words.first + row[at]
                    held.append(pa.table({"lang": langs.take(pa.array(own)), "phrase": phrase, "n": weights[own]}))
                    size += phrase.nbytes
                    if size > COMBINE_BYTES:
                        yield from _combined(held)
                        held, size = [], 0
        yield from _combined(held)

    return rows.select("lang", "piece", "m").mapInArrow(tidy(run), "lang string, phrase string, n long")


def count_buckets(found: DataFrame, least: int, memory: str = DUCKDB_MEMORY) -> DataFrame:
    """(lang, phrase, f): summed weights of at least `least`; each bucket is counted by DuckDB.

    DuckDB spills to the task's own temporary folder, which goes with the task, as Spark's sorts do.
    """
    kind = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spill = tempfile.mkdtemp(prefix="phrases-")
        try:
            with duckdb.connect(":memory:", config={"memory_limit": memory, "threads": 1, "temp_directory": spill, "preserve_insertion_order": False}) as con:
                rows = pa.RecordBatchReader.from_batches(kind, (pa.RecordBatch.from_arrays(b.columns, schema=kind) for b in batches))
                con.register("found", rows)
                out = con.sql(f"SELECT lang, phrase, sum(n)::BIGINT AS f FROM found GROUP BY lang, phrase HAVING sum(n) >= {int(least)}")
                yield from out.to_arrow_reader(1 << 16)
        finally:
            shutil.rmtree(spill, ignore_errors=True)

    return found.repartition("lang", "phrase").mapInArrow(tidy(run), "lang string, phrase string, f long")


def frequent_bits(counted: DataFrame, k: int, size: int = BITS) -> Broadcast:
    """The array of `size` bits over the hashes of (lang, phrase) of k words, whatever the number of phrases."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size >> 3, np.uint8)
        for batch in batches:
            seeds = _seeds(batch.column(0))
            for words in words_of(batch.column(1)):
                h = run_hashes(words.hashes, k)
                at = words.bounds[:-1]
                place = _places(h[at], seeds[words.first : words.first + words.n_rows], size)
                np.bitwise_or.at(bits, place >> 3, np.uint8(1) << (place & 7).astype(np.uint8))
        parts = bits.reshape(-1, CHUNK >> 3)
        for c in np.flatnonzero(parts.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([parts[c].tobytes()], pa.binary())], names=["chunk", "bits"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(b, np.uint8)
                held[c] = held[c] | own if c in held else own
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([b.tobytes() for b in held.values()], pa.binary())], names=["chunk", "bits"])

    chunks = "chunk int, bits binary"
    whole = np.zeros((size // CHUNK, CHUNK >> 3), np.uint8)
    for r in counted.select("lang", "phrase").mapInArrow(mark, chunks).repartition("chunk").mapInArrow(unite, chunks).toLocalIterator():
        whole[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    return counted.sparkSession.sparkContext.broadcast(whole.ravel())


def counts(rows: DataFrame, longest: int, least: int, size: int = BITS) -> list[DataFrame]:
    """For k of 1 to longest (lang, phrase, f): all phrases of k words that occur `least` times in (lang, piece, m)."""
    out, bits = [], None
    for k in range(1, longest + 1):
        out.append(table(count_buckets(grams(rows, k, bits), least), f"phrases{k}"))
        if bits is not None:
            bits.destroy()
        bits = frequent_bits(out[-1], k, size) if k < longest else None
    return out


def scored(candidates: DataFrame, known: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of candidates (lang, phrase, f) by their weakest cut.

    Each cut asks for the counts of its two parts: requests (lang, part) meet known (lang, phrase, f).
    """
    w = F.split("phrase", " ")
    cuts = F.sequence(F.lit(1), F.size(w) - 1)
    join = lambda x: F.array_join(x, " ")
    asked = candidates.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.flatten(F.transform(cuts, lambda j: F.array(
        F.struct(j.alias("cut"), F.lit(0).alias("side"), join(F.slice(w, 1, j)).alias("part")),
        F.struct(j.alias("cut"), F.lit(1).alias("side"), join(F.slice(w, j + 1, F.size(w))).alias("part")),
    )))).alias("q")).select("lang", "phrase", "a", "q.*")
    answers = asked.join(known.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    both = [(j, s) for j in range(1, longest) for s in (0, 1)]
    rows = answers.groupBy("lang", "phrase", "a").agg(*(F.max(F.when((F.col("cut") == j) & (F.col("side") == s), F.col("f"))).alias(f"f{j}{s}") for j, s in both))
    score = lambda j: F.expr(f"(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(f{j}0 as decimal(20,0)) + cast(f{j}1 as decimal(20,0)))")
    each = [F.when(F.col(f"f{j}0").isNotNull(), F.struct(score(j).alias("score"), F.lit(j).alias("cut"), F.col(f"f{j}0").alias("l"), F.col(f"f{j}1").alias("r"))) for j in range(1, longest)]
    return rows.select("lang", "phrase", "a", F.array_min(F.array_compact(F.array(*each))).alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def inner_parts(longer: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, within): the phrases of two words and more inside longer ones, with the largest count of those."""
    w = F.split("phrase", " ")
    spans = [(size, at) for size in range(2, longest) for at in range(1, longest - size + 2)]
    parts = F.array(*(F.when((F.size(w) > size) & (F.size(w) >= at + size - 1), F.array_join(F.slice(w, at, size), " ")) for size, at in spans))
    return longer.select("lang", F.explode(F.array_compact(parts)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("within"))


def first_of(rows: DataFrame, top: int, salts: int = 64) -> DataFrame:
    """The first `top` of each language, with rank: first of parts of a language, then of those."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    rows = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).drop("part")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 4, least: int = 30, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language.

    Words, pieces and counts are those of whole texts, A-Z lower-cased. A candidate has 2 to
    `longest` words and occurs a >= least times; its score is floor(2000000 a / (l + r)) at the
    cut into first part (l times) and rest (r times) with the lowest score, the first of equals. A
    candidate goes if a longer one that holds it occurs 0.8 a times or more. Ties are ordered by a
    and then by the bytes of the phrase. n is the number of words of the language.

    A null language is `und`; null and empty texts have no words; repeated rows and ids count as
    often as they stand; an empty table, or one without frequent phrases, gives an empty result.
    Other columns aren't read.
    """
    rows = table(pieces(docs, lang_col, text_col), "pieces")
    total = rows.groupBy("lang").agg(F.sum(F.col("m") * F.col("n_words")).alias("n"))
    levels = counts(rows, longest, least)
    union = lambda parts: reduce(DataFrame.union, parts)
    candidates = union(levels[1:])
    out = scored(candidates, union(levels[:-1]), longest)
    if longest > 2:
        out = out.join(inner_parts(union(levels[2:]), longest), ["lang", "phrase"], "left")
        out = out.where(F.col("within").isNull() | (F.col("within") * 5 < F.col("a") * 4))
    return first_of(out, top).join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
