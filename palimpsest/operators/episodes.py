"""Checks, orders and comparisons of whole episodes: a query with its candidates, or a run with another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def token_chunks(rows: DataFrame, key: str, words: str = "words", size: int = 512) -> DataFrame:
    """(key, chunk, n_words, text, previous): runs of `size` words, each naming the one before it."""
    n = F.ceil(F.size(words) / size).cast("int")
    at = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias("chunk")
    out = rows.select(key, words, at).select(key, "chunk", F.slice(words, F.col("chunk") * size + 1, size).alias("_w"))
    return out.select(key, "chunk", F.size("_w").alias("n_words"), F.array_join("_w", " ").alias("text"), F.when(F.col("chunk") > 0, F.col("chunk") - 1).alias("previous"))


def structural_issues(need: Column, hop: Column, answerable: Column, positives: Column, first: Column, overlaps: Column, holders: Column, attributes: Column) -> Column:
    """What is wrong with an episode, as an array of names.

    positives are the indices of its targets and holders those of the candidates with the answer;
    first is the index that the episode names; overlaps says whether the query shares content with
    its target; attributes are the candidates' labels.
    """
    known, one = F.size(positives) > 0, F.size(positives) == 1
    checks = {
        "unknown_with_need_or_hop": ~known & ((need != 0) | (hop != 0)),
        "unknown_answerable": ~known & answerable,
        "several_positives": known & ~one,
        "index_disagrees": one & (first != F.get(positives, F.lit(0))),
        "known_without_need_or_hop": one & ((need != 1) | (hop != 1)),
        "known_unanswerable": one & ~answerable,
        "overlaps_target": one & overlaps,
        "answer_elsewhere": one & ~(holders == positives),
        "repeated_attribute": one & (F.size(F.array_distinct(attributes)) < F.size(attributes)),
    }
    return F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items())), lambda x: x.isNotNull())


def answer_last(facts: DataFrame, group: str, order: str, positive: str, most: int) -> DataFrame:
    """facts with their place in the write order: distractors first, as many as the answers leave room for."""
    by = W.partitionBy(group)
    room = F.greatest(F.lit(0), most - F.sum(F.col(positive).cast("int")).over(by))
    nth = F.row_number().over(W.partitionBy(group, positive).orderBy(order))
    kept = facts.withColumn("_room", room).withColumn("_nth", nth).where(F.col(positive) | (F.col("_nth") <= F.col("_room"))).drop("_room", "_nth")
    return kept.withColumn("place", F.row_number().over(by.orderBy(positive, order)))


def prefixes(scored: DataFrame, group: str, score: str, tie: str, text: str, most: int = 2, least: float = 0.40) -> DataFrame:
    """(group, n_slots, prefix): the texts of the best slots that reach the least score, best first."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.col(score).desc(), tie))
    best = scored.where(F.col(score) >= least).withColumn("_rank", rank).where(F.col("_rank") <= most)
    held = F.sort_array(F.collect_list(F.struct("_rank", F.col(text).alias("_t"))))
    return best.groupBy(group).agg(F.count("*").alias("n_slots"), F.array_join(F.transform(held, lambda s: s["_t"]), " ").alias("prefix"))


def sweep_dominance(values: DataFrame, candidate: str, baseline: str) -> DataFrame:
    """(axis, direction, n_thresholds, holds): whether the candidate is no worse at every threshold.

    values has (threshold, axis, direction, system, value); thresholds that either lacks don't count.
    """
    own = values.where(F.col("system") == candidate).select("threshold", "axis", "direction", F.col("value").alias("_own"))
    base = values.where(F.col("system") == baseline).select("threshold", "axis", F.col("value").alias("_base"))
    both = own.join(base, ["threshold", "axis"]).where("_own is not null and _base is not null")
    gain = F.when(F.col("direction") == "max", F.col("_own") - F.col("_base")).otherwise(F.col("_base") - F.col("_own"))
    return both.groupBy("axis", "direction").agg(F.count("*").alias("n_thresholds"), F.bool_and(gain >= -1e-12).alias("holds"))


def write_survival(written: DataFrame, targets: DataFrame, group: str, category: str) -> DataFrame:
    """By category: rows written and still active, and targets whose value an active row still has.

    written has (group, category, value, active), targets (group, category, value).
    """
    kept = written.groupBy(category).agg(F.count("*").alias("n_written"), F.count_if("active").alias("n_active"))
    alive = written.where("active").select(group, "value").distinct().withColumn("_alive", F.lit(True))
    asked = targets.join(alive, [group, "value"], "left").groupBy(category).agg(F.count("*").alias("n_targets"), F.count_if("_alive").alias("n_survived"))
    return kept.join(asked, category, "left").na.fill(0, ["n_targets", "n_survived"])


def passes(reply: Column, acceptable: Column, forbidden: Column, answerable: Column, refused: Column) -> Column:
    """Whether a reply passes: nothing forbidden in it, and it holds an answer, or refuses rightly."""
    has = lambda marks: F.exists(marks, lambda m: (m != "") & F.contains(reply, m))
    return ~has(forbidden) & (has(acceptable) | (~answerable & refused))


def parity(teacher: DataFrame, student: DataFrame, key: str, category: str) -> DataFrame:
    """By category: cases of both runs, and how often each or both pass. Both have (key, category, passed)."""
    pairs = teacher.select(key, category, F.col("passed").alias("_t")).join(student.select(key, F.col("passed").alias("_s")), key)
    n = lambda c: F.count_if(c)
    t, s = F.col("_t"), F.col("_s")
    return pairs.groupBy(category).agg(F.count("*").alias("n"), n(t).alias("teacher"), n(s).alias("student"), n(t & s).alias("both"), n(t & ~s).alias("lost"), n(~t & s).alias("gained"))


def replace_buckets(buckets: DataFrame, fresh: DataFrame, page: str = "page_id", code: str = "code") -> DataFrame:
    """buckets with those of every page in fresh replaced by the page's distinct new codes."""
    return buckets.join(fresh.select(page).distinct(), page, "left_anti").select(page, code).union(fresh.select(page, code).distinct())
