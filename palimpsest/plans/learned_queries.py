"""Learned scorers, gates and folds; SQL can say some of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import learned as N
from ..operators import postings as P
from ..sources.files import generated_episodes, read_table
from .retrieval_queries import vectors


def small_layers() -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """Two fixed layers for pairs of 64 numbers."""
    rng = np.random.default_rng(3)
    return (rng.normal(0, 0.1, (256, 16)), np.zeros(16)), (rng.normal(0, 0.1, (16, 1)), np.zeros(1))


def q_pair_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query vector against the vectors of its label, by a fixed small network."""
    scores = N.block_scores(*vectors(spark, sf_dir), "label", N.PairMlp(small_layers()).block)
    return scores.withColumn("score", F.round("score", 6))


def q_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A softmax over vectors, fitted on three quarters, and its hits on each label of the rest."""
    e = read_table(spark, sf_dir, "embeddings")
    model = N.fit_logistic(e.where("vec_id % 4 <> 0"), "embedding", "label")
    out = N.predicted(model, e.where("vec_id % 4 = 0"), "embedding")
    return out.groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("prediction") == F.col("label")).alias("n_right"))


def q_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language, covered or not by the short documents; every language is in the vocabulary."""
    d = read_table(spark, sf_dir, "documents")
    asked = d.select(F.col("doc_id").alias("query_id"), F.when(F.col("doc_id") % 100 == 0, "xx").otherwise(F.col("lang")).alias("attribute"))
    return N.coverage_gate(asked, d.where("n_chars < 1000").select(F.col("lang").alias("attribute")), d.select(F.col("lang").alias("attribute"))).select("query_id", "attribute", "covered")


def q_hot_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events folded into four slots; a sequential rule that SQL can't say."""
    e = read_table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.concat("event_type", F.floor(F.col("value") / 20).cast("string")).alias("text"))
    return N.hot_slots(e, 4)


def q_forget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record that each request to forget means, the one of most shared tokens: benchmark items against turns."""
    q = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.terms(F.col("text")).alias("tokens"))
    r = read_table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("record_id"), T.terms(F.col("text")).alias("tokens"))
    return P.overlap_top_k(q, r, 1, N.FORGET_SHARE).select("query_id", "record_id")


def q_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand synthetic episodes, by attribute."""
    return generated_episodes(spark, 1000).groupBy("attribute").agg(F.count("*").alias("n"), F.count_if("answerable").alias("n_answerable"), F.max("value").alias("last_value"))


QUERIES = {f.__name__: f for f in (q_pair_mlp, q_logistic, q_coverage, q_hot_slots, q_forget, q_generated)}

_H = "('0x' || substr(sha1('0|{}|' || id), 1, 8))::BIGINT"
_HIDDEN = " + ".join(
    f"{float(w)!r} * greatest(0, list_dot_product(x, [{', '.join(repr(float(v)) for v in column)}]::DOUBLE[]))"
    for column, w in zip(small_layers()[0][0].T, small_layers()[1][0][:, 0], strict=True)
)

SQL = {
    "q_pair_mlp": f"""
        WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
        p AS (SELECT a.vec_id AS query_id, b.vec_id AS record_id, a.v AS a, b.v AS b FROM e a JOIN e b USING (label) WHERE a.vec_id % 20 = 0),
        f AS (SELECT query_id, record_id, list_concat(list_concat(a, b), list_concat(list_transform(range(1, 65), lambda i: a[i] * b[i]), list_transform(range(1, 65), lambda i: abs(a[i] - b[i])))) AS x FROM p)
        SELECT query_id, record_id, round(1 / (1 + exp(-({_HIDDEN}))), 6) AS score FROM f""",
    "q_coverage": """
        WITH b AS (SELECT DISTINCT lang FROM documents WHERE n_chars < 1000), v AS (SELECT DISTINCT lang FROM documents),
        a AS (SELECT doc_id AS query_id, CASE WHEN doc_id % 100 = 0 THEN 'xx' ELSE lang END AS attribute FROM documents)
        SELECT query_id, attribute, CASE WHEN (SELECT count(*) FROM b) >= 0.9 * (SELECT count(*) FROM v) THEN attribute IN (SELECT lang FROM b) END AS covered FROM a""",
    "q_forget": r"""
        WITH q AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[\x{4e00}-\x{9fff}]|[A-Za-z0-9_\-]+')) AS t FROM benchmark),
        a AS (SELECT query_id, len(t) AS n, unnest(t) AS w FROM q), r AS (SELECT conv_id * 1000 + turn AS record_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\x{4e00}-\x{9fff}]|[A-Za-z0-9_\-]+'))) AS w FROM conversations),
        s AS (SELECT query_id, record_id, count(*) / n AS score FROM a JOIN r USING (w) GROUP BY query_id, record_id, n)
        SELECT query_id, record_id FROM s WHERE score >= 0.22 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) = 1""",
    "q_generated": f"""
        WITH r AS (SELECT 'attribute_' || {_H.format("a")} % 8 AS attribute, 'value_' || {_H.format("new")} % 100 AS value, {_H.format("known")} % 4 <> 0 AS answerable FROM range(1000) r(id))
        SELECT attribute, count(*) AS n, count(*) FILTER (answerable) AS n_answerable, max(value) AS last_value FROM r GROUP BY attribute""",
}
