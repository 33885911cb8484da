"""Ranking, calibration and dominance metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_ranks(scored: DataFrame, by: Sequence[str] = ("query_id",), score: str = "score", relevant: str = "relevant", tie: str = "record_id") -> DataFrame:
    """Per query: rank of the first relevant row, relevant rows in the first 1, 3, 5 and 8, and the margin."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie)))
    hit = F.col(relevant)
    rows = scored.withColumn("_rank", rank)
    within = lambda k: F.sum(F.when(hit & (F.col("_rank") <= k), 1).otherwise(0))
    gain = lambda k: F.sum(F.when(hit & (F.col("_rank") <= k), 1 / F.log2(F.col("_rank") + 1)).otherwise(0.0))
    return rows.groupBy(*by).agg(
        F.min(F.when(hit, F.col("_rank"))).alias("first_rank"), F.sum(hit.cast("int")).alias("n_relevant"), *(within(k).alias(f"hits{k}") for k in (1, 3, 5, 8)),
        gain(3).alias("dcg3"), (F.max(F.when(hit, F.col(score))) - F.max(F.when(~hit, F.col(score)))).alias("margin"),
    )


def rank_summary(ranks: DataFrame, *by: str) -> DataFrame:
    """Recall, hit, reciprocal rank and gain over the queries that have a relevant row."""
    ideal = F.lit(0.0)
    for i in (1, 2, 3):
        ideal = ideal + F.when(F.col("n_relevant") >= i, 1 / F.log2(F.lit(i + 1.0))).otherwise(0.0)
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    recall = [mean(F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0), f"recall{k}") for k in (1, 3, 5, 8)]
    return ranks.where("n_relevant > 0").groupBy(*by).agg(
        F.count("*").alias("n_queries"), *recall, mean(1.0 / F.col("first_rank"), "mrr"), mean(F.col("dcg3") / ideal, "ndcg3"),
        mean(F.when(F.col("hits3") >= F.least(F.lit(3), F.col("n_relevant")), 1.0).otherwise(0.0), "all_in_top3"),
        mean(F.col("first_rank"), "mean_first_rank"), mean(F.col("margin"), "mean_margin"),
    )


def auc(rows: DataFrame, score: str, label: str, *by: str, parts: int = 256) -> DataFrame:
    """Area under the curve from rank sums, ties averaged.

    Ranks are made from the numbers of each distinct score, so rows themselves aren't numbered.
    The distinct scores of a group are cut at approximate quantiles, so that each task sums one
    range of them; where the cuts lie doesn't change the result.
    """
    at = rows.groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("_pos"), F.count("*").alias("_all"))
    names = [f"_by{i}" for i in range(len(by))]
    cuts = at.groupBy(*(F.col(c).alias(n) for c, n in zip(by, names, strict=True))).agg(F.percentile_approx(score, [i / parts for i in range(1, parts)], 10 * parts).alias("_cuts"))
    same = F.lit(True)
    for c, n in zip(by, names, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(n))
    joined = at.join(cuts, same) if by else at.crossJoin(cuts)  # without groups, one row
    at = joined.withColumn("_part", F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda x: x < F.col(score)))).drop("_cuts", *names)
    sums = at.groupBy(*by, "_part").agg(F.sum("_all").alias("_n"))
    sums = sums.withColumn("_ahead", F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    sums = sums.select(F.col("_part").alias("_p"), "_ahead", *(F.col(c).alias(n) for c, n in zip(by, names, strict=True)))
    at = at.join(sums, same & (F.col("_part") == F.col("_p"))).drop("_p", *names)
    before = W.partitionBy(*by, "_part").orderBy(score).rowsBetween(W.unboundedPreceding, -1)
    at = at.withColumn("_rank", F.col("_ahead") + F.coalesce(F.sum("_all").over(before), F.lit(0)) + (F.col("_all") + 1) / 2)
    n_pos, n_all = F.sum("_pos"), F.sum("_all")
    area = (F.sum(F.col("_pos") * F.col("_rank")) - n_pos * (n_pos + 1) / 2) / F.nullif(n_pos * (n_all - n_pos), F.lit(0))
    return at.groupBy(*by).agg(n_pos.alias("n_positive"), (n_all - n_pos).alias("n_negative"), F.round(area, 6).alias("auc"))


def sweep(rows: DataFrame, score: str, label: str, thresholds: Sequence[float]) -> DataFrame:
    """Per threshold: the four counts, precision, recall, F1, specificity and refusal rates.

    A metric with an empty denominator is null; F1 is also null if precision or recall is 0 or
    null. One pass makes a row's numbers for all thresholds.
    """
    cells = F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold")
    counted = rows.groupBy(score, label).agg(F.count("*").alias("_n")).select("*", cells)
    says, is_ = F.col(score) >= F.col("threshold"), F.col(label).cast("boolean")
    n = lambda c: F.sum(F.when(c, F.col("_n")).otherwise(0))
    out = counted.groupBy("threshold").agg(n(says & is_).alias("tp"), n(says & ~is_).alias("fp"), n(~says & is_).alias("fn"), n(~says & ~is_).alias("tn"))
    share = lambda a, b: F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0))
    p, r = share("tp", "fp"), share("tp", "fn")
    return out.withColumns({
        "precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(F.when((p > 0) & (r > 0), 2 * p * r / (p + r)), 6),
        "specificity": F.round(share("tn", "fp"), 6), "unknown_refusal": F.round(share("tn", "fp"), 6), "known_false_refusal": F.round(share("fn", "tp"), 6),
    })


def budgeted(swept: DataFrame, budget: float, gain: str = "unknown_refusal", cost: str = "known_false_refusal") -> DataFrame:
    """The threshold of the largest gain whose cost keeps to the budget; the first among equals."""
    return swept.where(F.col(cost) <= budget).orderBy(F.col(gain).desc(), "threshold").limit(1)


def policy_threshold(swept: DataFrame, most_false: float) -> DataFrame:
    """The threshold of best recall, then specificity, whose false positive rate keeps to the cap."""
    return swept.where(1 - F.col("specificity") <= most_false).orderBy(F.col("recall").desc(), F.col("specificity").desc(), "threshold").limit(1)


def confusion(rows: DataFrame, true: str, predicted: str, labels: Sequence[int]) -> DataFrame:
    """(true, predicted, n) of every pair of labels, empty cells included."""
    spark = rows.sparkSession
    cells = spark.createDataFrame([(int(a), int(b)) for a in labels for b in labels], "true int, predicted int")
    found = rows.groupBy(F.col(true).cast("int").alias("true"), F.col(predicted).cast("int").alias("predicted")).agg(F.count("*").alias("n"))
    return cells.join(found, ["true", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def percentile_index(values: Column, share: float, rule: str = "floor") -> Column:
    """A value of a list by one of three index rules: round(p (n-1)), floor(p n), floor(p n) clamped."""
    s = F.sort_array(values)
    n = F.size(s)
    at = {"round": F.rint(share * (n - 1)), "floor": F.floor(share * n), "clamped": F.least(n - 1, F.floor(share * n))}[rule].cast("int")
    return F.get(s, F.least(at, n - 1) if rule == "floor" else at)


def percentiles(rows: DataFrame, value: str, shares: dict[str, tuple[float, str]], *by: str) -> DataFrame:
    """(by, n, median, most, a column for each name of shares): percentiles by percentile_index's rules.

    shares is {name: (share, rule)}. Equal values are counted first, so a window holds distinct values
    and no list of all is made; the median interpolates. Null values don't count.
    """
    each = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_k"))
    n = F.sum("_k").over(W.partitionBy(*by))
    upto = F.sum("_k").over(W.partitionBy(*by).orderBy("_v"))
    each = each.withColumns({"_n": n, "_upto": upto})
    at = {"round": lambda p: F.rint(p * (F.col("_n") - 1)), "floor": lambda p: F.least(F.col("_n") - 1, F.floor(p * F.col("_n"))), "clamped": lambda p: F.least(F.col("_n") - 1, F.floor(p * F.col("_n")))}
    holds = lambda place: (place >= F.col("_upto") - F.col("_k")) & (place < F.col("_upto"))
    pick = lambda place: F.max(F.when(holds(place), F.col("_v")))
    middle = (F.col("_n") - 1) / 2
    out = each.groupBy(*by).agg(
        F.max("_n").alias("n"), ((pick(F.floor(middle)) + pick(F.ceil(middle))) / 2).alias("median"), F.max("_v").alias("most"), *(pick(at[rule](F.lit(p))).alias(name) for name, (p, rule) in shares.items())
    )
    return out


def verdicts(axes: DataFrame, candidate: str, slack: float = 0.03) -> DataFrame:
    """Per axis: the candidate against the best of the others, and whether it passes.

    axes has (axis, system, value, direction, noisy); direction is max or min; a noisy axis
    allows a relative loss of `slack`.
    """
    own = axes.where(F.col("system") == candidate).select("axis", "direction", "noisy", F.col("value").alias("candidate_value"))
    best = axes.where(F.col("system") != candidate).groupBy("axis").agg(F.max("value").alias("_max"), F.min("value").alias("_min"))
    out = own.join(best, "axis").withColumn("baseline_value", F.when(F.col("direction") == "max", F.col("_max")).otherwise(F.col("_min"))).drop("_max", "_min")
    delta = F.col("candidate_value") - F.col("baseline_value")
    gain = F.when(F.col("direction") == "max", delta).otherwise(-delta)
    allowed = F.when(F.col("noisy"), slack * F.abs("baseline_value")).otherwise(F.lit(0.0))
    return out.withColumn("delta", F.round(delta, 6)).withColumn("relative_pct", F.round(100 * delta / F.nullif(F.abs("baseline_value"), F.lit(0.0)), 6)).withColumn("pass", gain >= -allowed)


def flips(before: DataFrame, after: DataFrame, by: Sequence[str] = ("category", "query"), order: str = "pos", correct: str = "correct") -> DataFrame:
    """Rows of two runs, paired by key and their order within it, with what changed."""
    nth = F.row_number().over(W.partitionBy(*by).orderBy(order))
    a = before.select(*by, nth.alias("nth"), F.col(correct).alias("was"))
    b = after.select(*by, nth.alias("nth"), F.col(correct).alias("now"))
    change = (
        F.when(F.col("was").isNull(), "only_after").when(F.col("now").isNull(), "only_before").when(F.col("was") == F.col("now"), "same")
        .when(F.col("now"), "fixed").otherwise("broken")
    )
    return a.join(b, [*by, "nth"], "full").withColumn("change", change)


def flip_counts(paired: DataFrame, *by: str) -> DataFrame:
    n = lambda x: F.count_if(F.col("change") == x).alias(x)
    return paired.groupBy(*by).agg(F.count("*").alias("n"), n("fixed"), n("broken"), n("same"), n("only_before"), n("only_after"))


def quality_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Accuracy on answerable and unknown cases, wrong refusals, and the score's mean and largest value."""
    answerable, correct, refused = F.col("answerable"), F.col("correct"), F.col("refused")
    share = lambda a, b: F.round(F.count_if(a & b) / F.nullif(F.count_if(b), F.lit(0)), 6)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg(correct.cast("double")), 6).alias("overall"), share(correct, answerable).alias("answerable_accuracy"),
        share(refused, ~answerable).alias("unknown_refusal"), share(refused, answerable).alias("false_refusal"),
        F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.max("score"), 6).alias("max_score"),
    )


def centroids(rows: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """(key, centroid): element-wise means; sums combine before the shuffle."""
    flat = rows.select(key, F.posexplode(vector).alias("_i", "_x"))
    means = flat.groupBy(key, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    ordered = F.sort_array(F.collect_list(F.struct("_i", "_m")))
    return means.groupBy(key).agg(F.transform(ordered, lambda s: s["_m"]).alias("centroid"))
