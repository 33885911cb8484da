"""Mixing sources to target weights along a curriculum; DataFrame functions only.

Each source's target is its weighted share of all words, capped at a number of passes over
the source, what is over going to the others by weight. Over training time t in [0, 1] a
source's weight runs linearly: its rate is target * (1 + tilt * (2 t - 1)), whose integral is
the words demanded by t. A source's documents stand in a fixed order of hashes, repeated for
each pass; the words before a document's copy, put into the inverse of that integral, give
the copy's training position. A range sort by position makes the training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cluster import cut

#: By place among the sources in code point order, repeating: weights, and the slope of the
#: weight over training time (heavy sources early, light ones late).
WEIGHTS, TILTS = (5, 2, 1), (-0.5, 0.0, 0.5)
#: Passes over a source at most.
MOST_PASSES = 3
#: Parts into which each source's order is cut, so that no source is summed in one task.
PARTS = 4096

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = MOST_PASSES) -> DataFrame:
    """(source, place, weight, source_size, target) of the sources' sizes (source, source_size).

    A source is capped if its cap by weight is below the level that the remaining words make;
    in the order of cap by weight the first that isn't ends the capped ones. The table has a row
    for each source.
    """
    every = W.orderBy(F.col("source").asc_nulls_last())
    out = sizes.withColumn("place", F.row_number().over(every) - 1)
    out = out.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long"))
    out = out.withColumn("cap", passes * F.col("source_size"))
    whole = W.partitionBy()
    before = W.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    left_words = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), zero)
    left_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), zero)
    out = out.withColumn("left_words", left_words).withColumn("left_weight", left_weight)
    # capped: cap <= weight * level, with the level of the sources from this one on
    out = out.withColumn("open", F.col("cap") * F.col("left_weight") > F.col("weight") * F.col("left_words"))
    first = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "place", "left_words", "left_weight"))).over(whole)
    out = out.withColumn("first", first)
    shared = F.col("weight").cast("double") * F.col("first.left_words") / F.col("first.left_weight")
    capped = F.col("first").isNull() | (F.struct(F.col("cap") / F.col("weight"), "place") < F.struct(F.col("first.col1"), F.col("first.place")))
    return out.select("source", "place", "weight", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(shared).alias("target"))


def position(words: Column, target: Column, tilt: Column) -> Column:
    """The training time at which a source's demand reaches `words`: the integral's inverse."""
    u = F.when(target > 0, words / target).otherwise(F.lit(0.0))
    root = F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * u)
    return F.when(tilt == 0, u).otherwise(2 * u / ((1 - tilt) + root))


def _plan(rows: DataFrame, sums: DataFrame, weights: tuple[int, ...], tilts: tuple[float, ...], passes: int) -> DataFrame:
    """rows (id, source, size, rank, part, tie, ...) with source_size, target, tilt, offset, taken and copies.

    sums has (source, part, part_size). offset is the number of words before a row in its source's order.
    """
    targets = source_targets(sums.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, passes)
    ahead = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("part_size").over(ahead), F.lit(0)))
    starts = sums.join(targets, sums["source"].eqNullSafe(targets["source"])).select(
        sums["source"], "part", "ahead", "source_size", "target", F.element_at(F.array(*map(F.lit, tilts)), (F.col("place") % len(tilts) + 1).cast("int")).alias("tilt")
    )
    key = lambda df: [F.coalesce(df["source"], F.lit("")), df["source"].isNull(), df["part"]]
    rows = rows.select("*", *(c.alias(n) for c, n in zip(key(rows), ("k1", "k2", "k3"), strict=True)))
    starts = starts.select("ahead", "source_size", "target", "tilt", *(c.alias(n) for c, n in zip(key(starts), ("k1", "k2", "k3"), strict=True)))
    own = W.partitionBy("k1", "k2", "k3").orderBy("rank", "id", "size", "tie").rowsBetween(W.unboundedPreceding, -1)
    out = rows.withColumn("within", F.coalesce(F.sum("size").over(own), F.lit(0))).join(starts, ["k1", "k2", "k3"])
    out = out.withColumn("offset", F.col("ahead") + F.col("within")).withColumn("quota", F.floor("target"))
    part = [F.greatest(F.lit(0), F.least(F.col("size"), F.col("quota") - F.col("offset") - k * F.col("source_size"))) for k in range(passes)]
    out = out.withColumn("taken", sum(part[1:], part[0]).cast("long"))
    return out.withColumn("copies", sum((F.when(p > 0, 1).otherwise(0) for p in part[1:]), F.when(part[0] > 0, 1).otherwise(0)))


def _ranked(docs: DataFrame, id_col: str, text_col: str, source_col: str, parts: int, *more: Column) -> DataFrame:
    """(id, source, size, rank, part, tie, ...) of docs; tie tells rows of one id apart by their texts."""
    name = F.sha1(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8"))
    rank = F.conv(F.substring(name, 1, 15), 16, 10).cast("long")
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), rank.alias("rank"),
        (F.shiftright(rank, 40).cast("int") % parts).alias("part"), F.xxhash64(text_col).alias("tie"), *more,
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
        tilts: tuple[float, ...] = TILTS, passes: int = MOST_PASSES, parts: int = PARTS) -> DataFrame:
    """(id, size, source_size, target, taken, copies, position), a row for each row of docs.

    size counts words; target is the source's; taken are the words that the mix takes of the
    row, all passes together, at most `passes` times its size; copies is in how many passes it
    comes, the last perhaps in part; position is its first copy's training time, null if it
    has none. The rows are range-sorted by position. A source's taken words are its target,
    rounded down. Null texts have size 0 and are taken in no pass; a null source is a source,
    the last; rows that repeat an id, or have none, are separate rows of equal rank, told apart
    by their size and a hash of their text. An empty table gives an empty result. The targets
    are windows over one row for each source, in one task: the sources must be a few million at
    most. Texts are read once; the rest works on the sizes, written to the shared folder.
    """
    rows = cut(_ranked(docs, id_col, text_col, source_col, parts))
    out = _plan(rows, rows.groupBy("source", "part").agg(F.sum("size").alias("part_size")), weights, tilts, passes)
    out = out.withColumn("position", F.when(F.col("copies") > 0, position(F.col("offset"), F.col("target"), F.col("tilt"))))
    return out.select("id", "size", "source_size", "target", "taken", "copies", "position").orderBy(F.col("position").asc_nulls_last(), "id", "size")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
                    tilts: tuple[float, ...] = TILTS, passes: int = MOST_PASSES, parts: int = PARTS) -> DataFrame:
    """The columns of docs, a row for each copy that the mix takes, in the order of training.

    Copy k of a document comes when its source's demand reaches the words before it in k whole
    passes over the source and in this one, so later passes are spread over training as the
    weights say. A document that the mix takes in part comes whole. Every row goes through the
    mix with all its columns, whatever their names: rows that repeat an id, or have none, keep
    their own copies. Empty and null texts are in no copy; an empty table gives an empty result.
    """
    row = F.struct(*(docs[c] for c in docs.columns))
    rows = _ranked(docs, id_col, text_col, source_col, parts, row.alias("row"))
    sums = _ranked(docs, id_col, text_col, source_col, parts).groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    taken = _plan(rows, sums, weights, tilts, passes).where("copies > 0")
    taken = taken.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    at = position(F.col("offset") + F.col("pass") * F.col("source_size"), F.col("target"), F.col("tilt"))
    return taken.select("row", at.alias("at"), "id", "tie").orderBy("at", "id", "tie").select("row.*")
