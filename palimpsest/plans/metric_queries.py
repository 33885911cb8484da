"""Metrics over vectors with labels, labelled documents and conversations as stored runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import metrics as M
from ..operators import vector_index as X
from ..sources.files import markdown_table, read_table
from .retrieval_queries import _EVERY, DIMS, vectors

#: Neighbours that are ranked.
NEIGHBOURS = 32
THRESHOLDS = (0.1, 0.2, 0.3, 0.5, 0.7, 0.9)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The NEIGHBOURS nearest records of each query, by the vector index, and whether their labels agree."""
    q, r = vectors(spark, sf_dir)
    pairs = X.exact(q, r, NEIGHBOURS, dims=DIMS).drop("rank")
    return pairs.join(q.select("query_id", F.col("label").alias("q_label")), "query_id").join(r.select("record_id", "label"), "record_id").withColumn("relevant", F.col("label") == F.col("q_label"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, quality, toxic, score, lang): labelled documents with a made-up score."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.col("n_chars") % 1000 / 1000).alias("score"))
    return read_table(spark, sf_dir, "labels").join(d, "doc_id")


def q_first_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each query vector the rank of its first relevant neighbour, and the score margin."""
    out = M.first_ranks(_scored(spark, sf_dir))
    return out.select("query_id", "first_rank", "n_relevant", "hits1", "hits3", "hits5", "hits8", F.round("dcg3", 6).alias("dcg3"), F.round("margin", 6).alias("margin"))


def q_rank_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, reciprocal rank and gain, by label."""
    s = _scored(spark, sf_dir)
    return M.rank_summary(M.first_ranks(s, ("query_id", "q_label")), "q_label")


def q_rank_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, over all queries."""
    return M.rank_summary(M.first_ranks(_scored(spark, sf_dir)))


def q_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each query's list of scores looks like."""
    lists = _scored(spark, sf_dir).groupBy("query_id").agg(F.collect_list("score").alias("s"))
    names = ("top1", "top2", "margin", "top3_mean", "over_median", "std", "z", "entropy")
    return lists.select("query_id", V.geometry(F.col("s")).alias("g")).select("query_id", *(F.round(f"g.{n}", 6).alias(n) for n in names), "g.n_near")


def q_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the curve of the score, by language."""
    return M.auc(_labelled(spark, sf_dir), "score", "quality", "lang")


def q_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and refusal rates by threshold."""
    return M.sweep(_labelled(spark, sf_dir), "score", "quality", THRESHOLDS)


def q_budgeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold with most unknown refusals within a budget of false ones, and the policy's."""
    s = M.sweep(_labelled(spark, sf_dir), "score", "quality", THRESHOLDS)
    pick = lambda df, how: df.select(F.lit(how).alias("rule"), "threshold", "recall", "specificity")
    return pick(M.budgeted(s, 0.4), "budget").unionByName(pick(M.policy_threshold(s, 0.6), "policy"))


def q_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels against a rule's predictions."""
    return M.confusion(_labelled(spark, sf_dir).withColumn("predicted", F.col("doc_id") % 3), "quality", "predicted", (0, 1, 2))


def q_grouped_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality overall and by language and source, as one grouping set."""
    rows = _labelled(spark, sf_dir)
    return rows.groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("score"), 6).alias("score"))


def q_quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and refusals by language, of labelled documents as answers."""
    rows = _labelled(spark, sf_dir).select("lang", "score", (F.col("quality") == 1).alias("answerable"), (F.col("doc_id") % 3 == 0).alias("correct"), (F.col("doc_id") % 4 == 0).alias("refused"))
    return M.quality_summary(rows, "lang")


def q_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lengths by language: three index rules, and the interpolated median."""
    shares = {"p95_round": (0.95, "round"), "p95_floor": (0.95, "floor"), "p10": (0.1, "clamped"), "p90": (0.9, "clamped")}
    return M.percentiles(read_table(spark, sf_dir, "documents"), "n_chars", shares, "lang").drop("n")


def _axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).withColumn("system", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("new")), (F.col("doc_id") % 3 + 1).cast("int")))
    by = rows.groupBy("system").agg(F.round(F.avg("quality"), 6).alias("quality"), F.round(F.avg("toxic"), 6).alias("toxic"), F.round(F.avg("score"), 6).alias("score"))
    axes = by.unpivot("system", ["quality", "toxic", "score"], "axis", "value")
    return axes.withColumn("direction", F.when(F.col("axis") == "toxic", "min").otherwise("max")).withColumn("noisy", F.col("axis") == "score")


def q_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One system against the best of the others on each axis."""
    return M.verdicts(_axes(spark, sf_dir), "new").select("axis", "candidate_value", "baseline_value", "delta", "relative_pct", "pass")


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = read_table(spark, sf_dir, "conversations").select(F.col("role").alias("category"), F.col("turn").cast("string").alias("query"), F.col("conv_id").alias("pos"), "turn")
    before = c.where("pos % 10 <> 0").withColumn("correct", (F.col("pos") + F.col("turn")) % 3 == 0)
    after = c.where("pos % 11 <> 0").withColumn("correct", (F.col("pos") + F.col("turn")) % 2 == 0)
    return before, after


def q_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over the same turns, paired within category and query, and what changed."""
    return M.flips(*_runs(spark, sf_dir))


def q_flip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed, by category."""
    return M.flip_counts(M.flips(*_runs(spark, sf_dir)), "category")


def q_ranker_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scorers on the same candidates: the cosine, and one by number."""
    s = _scored(spark, sf_dir)
    both = s.select("query_id", "record_id", "relevant", F.expr("stack(2, 'cosine', score, 'number', cast(record_id * 37 % 101 as double) / 101) as (ranker, score)"))
    ranks = M.first_ranks(both, ("query_id", "ranker"))
    return M.rank_summary(ranks, "ranker").select("ranker", "n_queries", "recall1", "recall3", "mrr")


def q_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown table of labels by language."""
    rows = _labelled(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("quality"), F.sum("toxic").alias("toxic"))
    return markdown_table(rows, ["lang"])


def q_open_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifth percentile of the scores of good documents, and how many others lie above it."""
    rows = _labelled(spark, sf_dir)
    cut = rows.where("quality = 1").groupBy("lang").agg(F.round(F.expr("percentile(score, 0.05)"), 6).alias("threshold"))
    return rows.join(cut, "lang").groupBy("lang", "threshold").agg(F.count_if((F.col("quality") == 0) & (F.col("score") >= F.col("threshold"))).alias("n_open"))


def q_running_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each label's vectors the three nearest to its first one, with the gap to the one before."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("v"))
    first = e.groupBy("label").agg(F.min_by("v", "vec_id").alias("w"), F.min("vec_id").alias("first_id"))
    s = e.join(first, "label").where("vec_id <> first_id").select("label", "vec_id", F.round(V.cosine(F.col("v"), F.col("w")), 6).alias("score"))
    w = W.partitionBy("label").orderBy(F.col("score").desc(), "vec_id")
    return s.withColumn("rank", F.row_number().over(w)).withColumn("gap", F.round(F.lag("score").over(w) - F.col("score"), 5)).where("rank <= 3")


QUERIES = {
    f.__name__: f
    for f in (
        q_first_ranks, q_rank_summary, q_rank_total, q_geometry, q_auc, q_sweep, q_budgeted, q_confusion, q_grouped_scores, q_quality_summary, q_percentiles, q_verdict,
        q_flips, q_flip_counts, q_ranker_comparison, q_report, q_open_set, q_running_scores,
    )
}

_S = f"""{_EVERY},
    s AS (SELECT query_id, record_id, round(cosine, 6) AS score, a.label AS q_label, a.label = b.label AS relevant FROM n JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = record_id
          QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) <= {NEIGHBOURS})"""
_F = """
    k AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, record_id) AS rk FROM {rows}),
    f AS (SELECT {by}, min(rk) FILTER (relevant)::INT AS first_rank, count(*) FILTER (relevant) AS n_relevant, count(*) FILTER (relevant AND rk <= 1) AS hits1, count(*) FILTER (relevant AND rk <= 3) AS hits3,
          count(*) FILTER (relevant AND rk <= 5) AS hits5, count(*) FILTER (relevant AND rk <= 8) AS hits8, coalesce(sum(1 / log2(rk + 1)) FILTER (relevant AND rk <= 3), 0.0) AS dcg3,
          max(score) FILTER (relevant) - max(score) FILTER (NOT relevant) AS margin FROM k GROUP BY ALL)"""
_SUMMARY = (
    "count(*) AS n_queries, "
    + ", ".join(f"round(avg((first_rank <= {k})::INT), 6) AS recall{k}" for k in (1, 3, 5, 8))
    + """, round(avg(1.0::DOUBLE / first_rank), 6) AS mrr, round(avg(dcg3 / (1 + CASE WHEN n_relevant >= 2 THEN 1 / log2(3.0) ELSE 0 END + CASE WHEN n_relevant >= 3 THEN 1 / log2(4.0) ELSE 0 END)), 6) AS ndcg3,
    round(avg((hits3 >= least(3, n_relevant))::INT), 6) AS all_in_top3, round(avg(first_rank), 6) AS mean_first_rank, round(avg(margin), 6) AS mean_margin"""
)
_L = "l AS (SELECT doc_id, quality, toxic, n_chars % 1000 / 1000.0::DOUBLE AS score, lang, source FROM labels JOIN documents USING (doc_id))"
_T = ", ".join(f"({t}::DOUBLE)" for t in THRESHOLDS)
_SWEEP = f"""{_L},
    c AS (SELECT threshold, count(*) FILTER (score >= threshold AND quality = 1) AS tp, count(*) FILTER (score >= threshold AND quality = 0) AS fp,
          count(*) FILTER (score < threshold AND quality = 1) AS fn, count(*) FILTER (score < threshold AND quality = 0) AS tn FROM l CROSS JOIN (VALUES {_T}) t(threshold) GROUP BY threshold),
    r AS (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r, tn / nullif(tn + fp, 0) AS s, fn / nullif(fn + tp, 0) AS x FROM c),
    w AS (SELECT threshold, tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p > 0 AND r > 0 THEN 2 * p * r / (p + r) END, 6) AS f1,
          round(s, 6) AS specificity, round(s, 6) AS unknown_refusal, round(x, 6) AS known_false_refusal FROM r)"""
_FLIPS = """
    c AS (SELECT role AS category, turn::VARCHAR AS query, conv_id AS pos, turn FROM conversations),
    a AS (SELECT category, query, row_number() OVER (PARTITION BY category, query ORDER BY pos)::INT AS nth, (pos + turn) % 3 = 0 AS was FROM c WHERE pos % 10 <> 0),
    b AS (SELECT category, query, row_number() OVER (PARTITION BY category, query ORDER BY pos)::INT AS nth, (pos + turn) % 2 = 0 AS now FROM c WHERE pos % 11 <> 0),
    p AS (SELECT *, CASE WHEN was IS NULL THEN 'only_after' WHEN now IS NULL THEN 'only_before' WHEN was = now THEN 'same' WHEN now THEN 'fixed' ELSE 'broken' END AS change
          FROM a FULL JOIN b USING (category, query, nth))"""

SQL = {
    "q_first_ranks": f"WITH {_S}, {_F.format(by='query_id', rows='s')} SELECT query_id, first_rank, n_relevant, hits1, hits3, hits5, hits8, round(dcg3, 6) AS dcg3, round(margin, 6) AS margin FROM f",
    "q_rank_summary": f"WITH {_S}, {_F.format(by='query_id, q_label', rows='s')} SELECT q_label, {_SUMMARY} FROM f WHERE n_relevant > 0 GROUP BY q_label",
    "q_rank_total": f"WITH {_S}, {_F.format(by='query_id', rows='s')} SELECT {_SUMMARY} FROM f WHERE n_relevant > 0",
    "q_geometry": f"""
        WITH {_S}, g AS (SELECT query_id, list_reverse_sort(list(score)) AS s FROM s GROUP BY query_id),
        m AS (SELECT *, len(s) AS n, coalesce(s[1], 0.0) AS top1, coalesce(s[2], 0.0) AS top2, list_avg(s) AS mean, list_stddev_pop(s) AS sd, list_transform(s, lambda x: exp(x - s[1])) AS e FROM g)
        SELECT query_id, round(top1, 6) AS top1, round(top2, 6) AS top2, round(top1 - top2, 6) AS margin, round(list_avg(s[1:3]), 6) AS top3_mean, round(top1 - s[n // 2 + 1], 6) AS over_median, round(sd, 6) AS std,
               round(CASE WHEN sd > 0 THEN (top1 - mean) / sd ELSE 0 END, 6) AS z, round(-list_sum(list_transform(e, lambda x: x / list_sum(e) * ln(x / list_sum(e)))), 6) AS entropy,
               len(list_filter(s, lambda x: x >= top1 - 0.1::DOUBLE * abs(top1)))::INT AS n_near FROM m""",
    "q_auc": f"""
        WITH {_L}, v AS (SELECT lang, score, sum(quality) AS pos, count(*) AS n FROM l GROUP BY ALL),
        r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS rk FROM v)
        SELECT lang, sum(pos)::BIGINT AS n_positive, (sum(n) - sum(pos))::BIGINT AS n_negative, round((sum(pos * rk) - sum(pos) * (sum(pos) + 1) / 2) / nullif(sum(pos) * (sum(n) - sum(pos)), 0), 6) AS auc FROM r GROUP BY lang""",
    "q_sweep": f"WITH {_SWEEP} SELECT * FROM w",
    "q_budgeted": f"""
        WITH {_SWEEP} (SELECT 'budget' AS rule, threshold, recall, specificity FROM w WHERE known_false_refusal <= 0.4 ORDER BY unknown_refusal DESC, threshold LIMIT 1)
        UNION ALL (SELECT 'policy', threshold, recall, specificity FROM w WHERE 1 - specificity <= 0.6 ORDER BY recall DESC, specificity DESC, threshold LIMIT 1)""",
    "q_confusion": f"""
        WITH {_L}, c AS (SELECT quality AS t, doc_id % 3 AS p, count(*) AS n FROM l GROUP BY ALL)
        SELECT a.i::INT AS "true", b.i::INT AS predicted, coalesce(n, 0) AS n FROM range(3) a(i) CROSS JOIN range(3) b(i) LEFT JOIN c ON t = a.i AND p = b.i""",
    "q_grouped_scores": f"WITH {_L} SELECT lang, source, count(*) AS n, round(avg(quality), 6) AS quality, round(avg(score), 6) AS score FROM l GROUP BY GROUPING SETS ((lang), (source), ())",
    "q_quality_summary": f"""
        WITH {_L}, r AS (SELECT lang, score, quality = 1 AS a, doc_id % 3 = 0 AS c, doc_id % 4 = 0 AS x FROM l)
        SELECT lang, count(*) AS n, round(avg(c::INT), 6) AS overall, round(count(*) FILTER (c AND a) / nullif(count(*) FILTER (a), 0), 6) AS answerable_accuracy, round(count(*) FILTER (x AND NOT a) / nullif(count(*) FILTER (NOT a), 0), 6) AS unknown_refusal,
               round(count(*) FILTER (x AND a) / nullif(count(*) FILTER (a), 0), 6) AS false_refusal, round(avg(score), 6) AS mean_score, round(max(score), 6) AS max_score FROM r GROUP BY lang""",
    "q_percentiles": """
        WITH g AS (SELECT lang, list_sort(list(n_chars)) AS v, quantile_cont(n_chars, 0.5) AS median, max(n_chars) AS most, count(*) AS n FROM documents GROUP BY lang)
        SELECT lang, median, most, v[round_even(0.95::DOUBLE * (n - 1), 0)::INT + 1] AS p95_round, v[least(n, floor(0.95::DOUBLE * n)::INT + 1)] AS p95_floor, v[least(n, floor(0.1::DOUBLE * n)::INT + 1)] AS p10, v[least(n, floor(0.9::DOUBLE * n)::INT + 1)] AS p90 FROM g""",
    "q_verdict": f"""
        WITH {_L}, y AS (SELECT ['a', 'b', 'new'][(doc_id % 3 + 1)::INT] AS system, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic, round(avg(score), 6) AS score FROM l GROUP BY 1),
        u AS (UNPIVOT y ON quality, toxic, score INTO NAME axis VALUE value),
        b AS (SELECT axis, max(value) AS hi, min(value) AS lo FROM u WHERE system <> 'new' GROUP BY axis),
        c AS (SELECT axis, value AS candidate_value, CASE WHEN axis = 'toxic' THEN lo ELSE hi END AS baseline_value FROM u JOIN b USING (axis) WHERE system = 'new')
        SELECT axis, candidate_value, baseline_value, round(candidate_value - baseline_value, 6) AS delta, round(100 * (candidate_value - baseline_value) / nullif(abs(baseline_value), 0), 6) AS relative_pct,
               (CASE WHEN axis = 'toxic' THEN -1 ELSE 1 END) * (candidate_value - baseline_value) >= -(CASE WHEN axis = 'score' THEN 0.03::DOUBLE * abs(baseline_value) ELSE 0 END) AS pass FROM c""",
    "q_flips": f"WITH {_FLIPS} SELECT * FROM p",
    "q_flip_counts": f"WITH {_FLIPS} SELECT category, count(*) AS n, " + ", ".join(f"count(*) FILTER (change = '{x}') AS {x}" for x in ("fixed", "broken", "same", "only_before", "only_after")) + " FROM p GROUP BY category",
    "q_ranker_comparison": f"""
        WITH {_S}, y AS (SELECT query_id, record_id, relevant, 'cosine' AS ranker, score FROM s UNION ALL SELECT query_id, record_id, relevant, 'number', (record_id * 37 % 101) / 101.0::DOUBLE FROM s), {_F.format(by="query_id, ranker", rows="y")},
        z AS (SELECT ranker, {_SUMMARY} FROM f WHERE n_relevant > 0 GROUP BY ranker) SELECT ranker, n_queries, recall1, recall3, mrr FROM z""",
    "q_report": f"""
        WITH {_L}, g AS (SELECT lang, count(*) AS n, sum(quality) AS q, sum(toxic) AS t FROM l GROUP BY lang)
        SELECT 0 AS line_no, '| lang | n | quality | toxic |' AS line UNION ALL SELECT 1, '|---|---|---|---|'
        UNION ALL SELECT (row_number() OVER (ORDER BY lang) + 1)::INT, '| ' || lang || ' | ' || n || ' | ' || q || ' | ' || t || ' |' FROM g""",
    "q_open_set": f"""
        WITH {_L}, c AS (SELECT lang, round(quantile_cont(score, 0.05), 6) AS threshold FROM l WHERE quality = 1 GROUP BY lang)
        SELECT lang, threshold, count(*) FILTER (quality = 0 AND score >= threshold) AS n_open FROM l JOIN c USING (lang) GROUP BY ALL""",
    "q_running_scores": f"""
        WITH f AS (SELECT label, min_by(embedding, vec_id) AS w, min(vec_id) AS i FROM embeddings GROUP BY label),
        d AS (SELECT e.label, vec_id, embedding AS v, w FROM embeddings e JOIN f USING (label) WHERE vec_id <> i),
        s AS (SELECT label, vec_id, round(list_sum(list_transform(range(1, 65), lambda i: v[i]::DOUBLE * w[i]::DOUBLE)) / (sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(w, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS score FROM d)
        SELECT label, vec_id, score, row_number() OVER o::INT AS rank, round(lag(score) OVER o - score, 5) AS gap FROM s WINDOW o AS (PARTITION BY label ORDER BY score DESC, vec_id) QUALIFY rank <= 3""",
}
