"""Retrieval: benchmark items as queries, documents as records, embeddings as vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import metrics as M
from ..operators import postings as P
from ..operators import retrieval as R
from ..operators import vector_index as X
from ..sources.files import held, read_spread, read_table
from .text_queries import lexical_sql, terms_sql, tokens_sql

BITS, DIMS = 8, 64


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query, tokens)."""
    return read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), T.tokens(F.col("text")).alias("tokens"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, entity, attribute, tokens), the texts taken apart once for all uses."""
    return held(read_spread(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("record_id"), F.col("source").alias("entity"), F.col("lang").alias("attribute"), T.tokens(F.col("text")).alias("tokens")
    ))


def named_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records whose names come from their text's first words."""
    words = T.bm25_words(F.col("text"))
    word = lambda i: F.coalesce(F.get(words, F.lit(i)), F.lit(""))
    return read_spread(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("record_id"), word(2).alias("entity"), F.concat(F.lit("symbol:"), word(3)).alias("attribute"), word(4).alias("value")
    )


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every twentieth vector as a query, all as records."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")
    return e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "record_id")


def q_lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents of each benchmark item, by lexical score among those that share a rare term."""
    return R.lexical_top_k(queries(spark, sf_dir), records(spark, sf_dir), 5)


def q_evidence_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share telling rare terms with an item."""
    return R.evidence_hits(queries(spark, sf_dir), records(spark, sf_dir))


def q_address_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose names an item holds, and whether the address rules agree."""
    q, r = queries(spark, sf_dir), named_records(spark, sf_dir)
    pairs = R.address_hits(q, r).join(q, "query_id").join(r, "record_id")
    agrees = R.matches_address(F.col("query"), F.col("tokens"), F.col("entity"), F.col("attribute"), F.col("value"))
    return pairs.select("query_id", "record_id", agrees.alias("agrees"))


def q_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each item by BM25, from score-bounded postings."""
    q = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.bm25_words(F.col("text")).alias("words"))
    r = read_spread(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), T.bm25_words(F.col("text")).alias("words"))
    return P.bm25_top_k(q, r, 10)


def q_bm25_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 within conversations: the first turn asks, the others answer."""
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", T.bm25_words(F.col("text")).alias("words"))
    q = c.where("turn = 0").select(F.col("conv_id").alias("query_id"), "conv_id", "words")
    r = c.where("turn > 0").select((F.col("conv_id") * 1000 + F.col("turn")).alias("record_id"), "conv_id", "words")
    return R.top_k(R.bm25(q, r, pool="conv_id").withColumn("score", F.round("score", 6)), 3)


def q_lexical_rag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical baseline over candidates that share a rare term."""
    q, r = queries(spark, sf_dir), records(spark, sf_dir)
    texts = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), F.col("source").alias("entity"), F.col("lang").alias("attribute"), "text")
    pairs = R.lexical_candidates(q, r)
    own = texts.join(pairs.select("record_id").distinct(), "record_id", "left_semi").select("record_id", "entity", "attribute", T.terms(F.col("text")).alias("r_terms"))
    pairs = pairs.join(q.select("query_id", "query", T.terms(F.col("query")).alias("q_terms")), "query_id").join(own, "record_id")
    scored = R.lexical_rag(pairs).select("query_id", "record_id", F.round("score", 6).alias("score"))
    return R.top_k(scored, 5)


def _scored(spark: SparkSession, sf_dir: str, r: DataFrame | None = None) -> DataFrame:
    q, r = queries(spark, sf_dir), records(spark, sf_dir) if r is None else r
    pairs = R.lexical_candidates(q, r).join(q.select("query_id", "query", F.col("tokens").alias("q_tokens")), "query_id").join(
        r.select("record_id", "entity", "attribute", F.col("tokens").alias("r_tokens")), "record_id"
    )
    pairs = pairs.withColumns({
        "value": F.lit(""), "confidence": F.col("record_id") % 10 / 10, "importance": F.col("record_id") % 4 / 4, "routed": (F.col("record_id") * 7 + F.col("query_id")) % 100 / 100,
    })
    return R.record_scores(pairs, R.rare_scores(q, r))


def q_record_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term of the record score of each candidate."""
    names = ("s_routed", "s_lexical", "s_overlap", "s_quality", "s_rare", "s_shape", "s_structured", "s_entity", "s_attribute", "score")
    return _scored(spark, sf_dir).select("query_id", "record_id", *(F.round(n, 6).alias(n) for n in names))


def q_page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best sources of each item, sources being pages."""
    s = _scored(spark, sf_dir)
    rows = s.select(
        "query_id", F.col("entity").alias("page_id"), "routed", (F.size("r_tokens") > 0).alias("has_tokens"), F.lit(0.5).alias("page_importance"), F.lit(1.0).alias("age_hours"),
        T.lexical_score(F.col("q_tokens"), F.col("r_tokens")).alias("lexical"), (F.col("s_rare") / 1.25).alias("rare"), (F.col("s_entity") > 0).alias("entity_hit"),
        (F.col("s_attribute") > 0).alias("attribute_hit"), (F.col("s_overlap") / 0.45).alias("overlap"),
    )
    return R.top_k(R.page_scores(rows).withColumn("score", F.round("score", 6)), 3, tie="page_id")


def q_read_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each item's read stops: gates over its best two scores."""
    q, r = queries(spark, sf_dir), records(spark, sf_dir)
    best = R.top_k(_scored(spark, sf_dir, r), 2).groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("top2"))
    hits = R.evidence_hits(q, r).groupBy("query_id").agg(F.max("n_terms").alias("shared_tokens"))
    asked = q.join(best, "query_id", "left").join(hits, "query_id", "left").select(
        "query_id", "query", "top1", "top2", F.coalesce("shared_tokens", F.lit(0)).alias("shared_tokens"), (F.coalesce("shared_tokens", F.lit(0)) > 8).alias("has_evidence"),
        (F.col("query_id") % 10 / 10).alias("need"), F.when(F.col("query_id") % 4 == 0, F.col("query_id") % 8 == 0).alias("covered"), (F.col("query_id") % 3 != 0).alias("attribute_known"),
    )
    out = R.read_gates(asked, least_margin=0.05)
    return out.select("query_id", "stop_reason", "reads", F.round("margin", 6).alias("margin"), F.round("confidence", 6).alias("confidence"))


def q_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of each query vector among all, compared in blocks."""
    return R.dense_top_k(*vectors(spark, sf_dir), 5)


def q_signature_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of each query vector among those with a near signature: the coarse probe by itself."""
    return R.signature_top_k(*vectors(spark, sf_dir), 5, BITS, DIMS)


def q_dense_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As q_dense_topk, under the name that it had beside the signature probe."""
    return R.dense_top_k(*vectors(spark, sf_dir), 5)


def q_dense_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As q_dense_topk, through the vector index: codes with their bounds first, then as they are the vectors that can be among the five."""
    return X.exact(*vectors(spark, sf_dir), 5, dims=DIMS)


def q_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by signature, and the bits between each and the first one of its label."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("v")).withColumn("code", V.signature(F.col("v"), BITS, DIMS))
    first = e.groupBy("label").agg(F.min_by("code", "vec_id").alias("first_code"))
    return e.join(first, "label").select("vec_id", "code", V.hamming(F.col("code"), F.col("first_code")).alias("bits"), F.round(V.norm(F.col("v")), 5).alias("norm"))


def q_dense_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as documents of the same number: the eight nearest by the vector index, reranked with their texts."""
    q, r = vectors(spark, sf_dir)
    d = read_table(spark, sf_dir, "documents")
    text = lambda name, prefix: d.select(F.col("doc_id").alias(name), F.col("text").alias(f"{prefix}_text"), F.col("source").alias(f"{prefix}_source"), F.col("lang").alias(f"{prefix}_lang"))
    top = X.exact(q, r, 8, digits=12, dims=DIMS).withColumnRenamed("score", "cosine")
    pairs = top.join(text("query_id", "q"), "query_id").join(text("record_id", "r"), "record_id")
    pairs = pairs.select(
        "query_id", "record_id", "cosine", F.concat_ws(" ", "q_source", "q_text").alias("query"), T.terms(F.col("q_text")).alias("q_terms"), T.terms(F.col("r_text")).alias("r_terms"),
        F.col("r_source").alias("entity"), F.col("r_lang").alias("attribute"),
    )
    return R.top_k(R.dense_rerank(pairs).select("query_id", "record_id", F.round("score", 6).alias("score")), 3)


def q_dense_rerank_united(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As q_dense_rerank, of all candidates: the exact dense top 32 united with the records of rare terms and of addresses."""
    e = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record_id"), F.col("embedding").alias("vector"))
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), "source", "lang", "text")
    own = e.join(d, "record_id")  # only texts that have a vector are taken apart
    query = F.when(F.col("record_id") % 20 == 0, F.concat_ws(" ", "source", "text")).alias("query")
    r = held(own.select("record_id", query, F.col("source").alias("entity"), F.col("lang").alias("attribute"), T.terms(F.col("text")).alias("tokens"), "vector"))
    q = r.where("record_id % 20 = 0").select(F.col("record_id").alias("query_id"), "query", "tokens", "vector")
    r = r.drop("query")
    return R.dense_rerank_top_k(q, r, R.rerank_candidates(q, r), 3)


def q_chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three chunks of 1,800 characters that share most terms with each item."""
    c = read_spread(spark, sf_dir, "documents").select("doc_id", F.explode(T.chunks(F.col("text"))).alias("c"))
    c = c.select((F.col("doc_id") * 1000 + F.col("c.start") / 1800).cast("long").alias("chunk_id"), T.terms(F.col("c.chunk")).alias("tokens"))
    q = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.terms(F.col("text")).alias("tokens"))
    return P.overlap_top_k(q, c, 3, key="chunk_id")


def q_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns within three links of each conversation's first: a turn links to the next and to twice its number."""
    c = read_table(spark, sf_dir, "conversations")
    seeds = c.where("turn = 0").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("record_id"))
    at = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("record_id"))
    seeds = seeds.select("query_id", (F.col("query_id") * 1000).alias("record_id"))
    turn = F.col("record_id") % 1000
    edges = at.select("record_id", F.explode(F.array(F.col("record_id") + 1, F.col("record_id") + turn)).alias("related_id")).join(at.withColumnRenamed("record_id", "related_id"), "related_id", "left_semi")
    return R.hops(seeds, edges, 3)


def q_evidence_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within a conversation, turns whose first word occurs in an earlier link of the chain."""
    c = read_table(spark, sf_dir, "conversations")
    facts = c.select(F.col("conv_id").alias("group_id"), F.col("turn").alias("seq"), F.lower("text").alias("text"), F.lower(F.regexp_extract("text", "^([A-Za-z]+)", 1)).alias("value"))
    return R.evidence_chain(facts).where("hop > 0")


def q_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of each label, flattened."""
    e = read_table(spark, sf_dir, "embeddings").select("label", F.col("embedding").alias("vector"))
    out = M.centroids(e, "label").select("label", F.posexplode("centroid").alias("dim", "x"))
    return out.select("label", "dim", F.round("x", 5).alias("x"))


QUERIES = {
    f.__name__: f
    for f in (
        q_lexical_topk, q_evidence_hits, q_address_hits, q_bm25, q_bm25_pools, q_lexical_rag, q_record_scores, q_page_scores, q_read_gates, q_dense_topk, q_signature_probe, q_dense_exact_topk, q_dense_index_topk, q_signatures,
        q_dense_rerank, q_dense_rerank_united, q_chunk_overlap, q_hops, q_evidence_chain, q_centroids,
    )
}

_ADDRESS = r"(length(term) >= 8 OR regexp_matches(term, '[0-9_\-./\\]'))"
_SYMBOL = "regexp_full_match(term, '[a-z_]{3,}')"
_VALUE = r"(length(term) >= 4 AND (regexp_matches(term, '[0-9_\-./\\]') OR regexp_full_match(term, '[a-z]+')))"
_SETS = f"""
    q AS (SELECT item_id AS query_id, text AS query, {tokens_sql("text")} AS tokens FROM benchmark),
    r AS (SELECT doc_id AS record_id, text, source AS entity, lang AS attribute, {tokens_sql("text")} AS tokens FROM documents),
    qt AS (SELECT query_id, unnest(tokens) AS term FROM q), rt AS (SELECT record_id, unnest(tokens) AS term FROM r),
    df AS (SELECT term, count(*) AS df FROM rt GROUP BY term),
    sh AS (SELECT query_id, record_id, term, df FROM rt JOIN df USING (term) JOIN qt USING (term)),
    c AS (SELECT DISTINCT query_id, record_id FROM sh WHERE df <= 64)"""


def _top_sql(rows: str, k: int, tie: str = "record_id") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {tie})::INT AS rank FROM ({rows}) QUALIFY rank <= {k}"


_SCORED = f"""{_SETS},
    rare AS (SELECT query_id, record_id, least(2.0, count(*)::DOUBLE)::DOUBLE AS rare FROM sh WHERE df <= 32 GROUP BY ALL),
    p AS (SELECT c.query_id, c.record_id, q.query, q.tokens AS qk, r.tokens AS rk, r.entity, r.attribute, coalesce(rare, 0.0)::DOUBLE AS rare FROM c JOIN q USING (query_id) JOIN r USING (record_id) LEFT JOIN rare USING (query_id, record_id)),
    m AS (SELECT *, length(entity) >= 4 AND contains(lower(query), lower(entity)) AS named FROM p),
    s AS (SELECT query_id, record_id, entity, rare, len(rk) > 0 AS has_tokens, {lexical_sql("qk", "rk")} AS lexical, CASE WHEN len(qk) = 0 THEN 0.0 ELSE len(list_intersect(qk, rk))::DOUBLE / len(qk) END AS overlap,
            ((record_id * 7 + query_id) % 100 / 100.0)::DOUBLE AS s_routed, 0.10::DOUBLE * (record_id % 10 / 10.0)::DOUBLE + 0.08::DOUBLE * (record_id % 4 / 4.0)::DOUBLE AS s_quality, 1.25::DOUBLE * rare AS s_rare,
            CASE WHEN len(rk) > 0 THEN 0.35::DOUBLE ELSE 0 END AS s_shape, CASE WHEN entity <> '' OR attribute <> '' THEN 0.15::DOUBLE ELSE 0 END AS s_structured,
            CASE WHEN named THEN 2.5::DOUBLE ELSE 0 END AS s_entity, CASE WHEN named AND attribute <> '' AND contains(lower(query), lower(attribute)) THEN 0.75::DOUBLE ELSE 0 END AS s_attribute FROM m),
    t AS (SELECT *, 0.25::DOUBLE * lexical AS s_lexical, 0.45::DOUBLE * overlap AS s_overlap FROM s),
    z AS (SELECT *, s_routed + s_lexical + s_overlap + s_quality + s_rare + s_shape + s_structured + s_entity + s_attribute AS score FROM t)"""
_BM25 = """
    st AS (SELECT {pool} count(*) AS n, avg(len(words)) AS mean FROM r GROUP BY ALL),
    qt AS (SELECT query_id, {pool} word, count(*) AS times FROM (SELECT query_id, {pool} unnest(words) AS word FROM q) GROUP BY ALL),
    tf AS (SELECT record_id, {pool} n_words, word, count(*) AS tf FROM (SELECT record_id, {pool} len(words) AS n_words, unnest(words) AS word FROM r) GROUP BY ALL),
    df AS (SELECT {pool} word, count(*) AS df FROM tf GROUP BY ALL),
    s AS (SELECT query_id, record_id, round(sum(times * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n_words / mean))), 6) AS score
          FROM tf JOIN df USING ({pool} word) JOIN qt USING ({pool} word) {stats} GROUP BY ALL)"""
_DOT = "list_sum(list_transform(range(1, 65), lambda i: {}[i]::DOUBLE * {}[i]::DOUBLE))"
_CODE = " + ".join(f"(CASE WHEN list_sum(list_transform(range(1, 65), lambda i: v[i]::DOUBLE * {V.plane(b, DIMS)}[i])) >= 0 THEN {1 << b} ELSE 0 END)" for b in range(BITS))
_VECTORS = f"""
    e AS (SELECT vec_id, label, v, ({_CODE})::BIGINT AS code FROM (SELECT vec_id, label, embedding AS v FROM embeddings)),
    n AS (SELECT a.vec_id AS query_id, b.vec_id AS record_id, {_DOT.format("a.v", "b.v")} / (sqrt({_DOT.format("a.v", "a.v")}) * sqrt({_DOT.format("b.v", "b.v")})) AS cosine
          FROM e a JOIN e b ON bit_count(xor(a.code, b.code)) <= 2 AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)"""

_EVERY = _VECTORS.replace("ON bit_count(xor(a.code, b.code)) <= 2 AND a.vec_id <> b.vec_id", "ON a.vec_id <> b.vec_id")

SQL = {
    "q_lexical_topk": f"WITH {_SETS} " + _top_sql(f"SELECT query_id, record_id, round({lexical_sql('q.tokens', 'r.tokens')}, 6) AS score FROM c JOIN q USING (query_id) JOIN r USING (record_id)", 5),
    "q_evidence_hits": f"""
        WITH {_SETS}, h AS (SELECT query_id, record_id, count(*) AS n_terms, bool_or(regexp_full_match(term, '[a-z_]*') AND ({_ADDRESS} OR {_SYMBOL} OR {_VALUE})) AS telling,
                            bool_or(regexp_full_match(term, '[a-z_]*')) AS letters FROM sh WHERE df <= 64 GROUP BY ALL)
        SELECT query_id, record_id, n_terms FROM h WHERE telling OR (letters AND n_terms >= 2) OR n_terms >= 3""",
    "q_address_hits": rf"""
        WITH q AS (SELECT item_id AS query_id, text AS query, {tokens_sql("text")} AS tokens FROM benchmark), qt AS (SELECT query_id, unnest(tokens) AS term FROM q),
        w AS (SELECT doc_id AS record_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM documents),
        r AS (SELECT record_id, coalesce(w[3], '') AS entity, 'symbol:' || coalesce(w[4], '') AS attribute, coalesce(w[5], '') AS value FROM w),
        k AS (SELECT *, {tokens_sql("entity")} AS ek, {tokens_sql("attribute")} AS ak, {tokens_sql("value")} AS vk FROM r),
        n AS (SELECT DISTINCT record_id, term FROM (SELECT record_id, unnest(list_concat(ek, ak)) AS term FROM k) WHERE {_ADDRESS} OR {_SYMBOL}),
        v AS (SELECT record_id, term FROM (SELECT record_id, unnest(vk) AS term FROM k) WHERE {_VALUE}),
        h AS (SELECT query_id, record_id FROM n JOIN qt USING (term) WHERE term IN (SELECT term FROM n GROUP BY term HAVING count(*) <= 256)
              UNION SELECT query_id, record_id FROM v JOIN qt USING (term) WHERE term IN (SELECT term FROM v GROUP BY term HAVING count(*) <= 128)),
        x AS (SELECT query_id, record_id, entity, attribute, contains(lower(query), entity) OR len(list_filter(ek, lambda term: list_contains(tokens, term) AND {_ADDRESS})) > 0 AS em,
              contains(lower(query), attribute) OR len(list_filter(ak, lambda term: list_contains(tokens, term) AND ({_ADDRESS} OR {_SYMBOL}))) > 0 AS am,
              len(list_filter(vk, lambda term: list_contains(tokens, term) AND {_VALUE})) > 0 AS vm, regexp_matches(lower(query), '(?:[a-z0-9_.\\/-]+)\.(?:py|md|json|toml|yaml|yml)') AS fm
              FROM h JOIN q USING (query_id) JOIN k USING (record_id))
        SELECT query_id, record_id, CASE WHEN entity = '' THEN false WHEN fm AND NOT em THEN false WHEN NOT em AND NOT am AND NOT vm THEN false WHEN NOT em THEN true ELSE am OR vm END AS agrees FROM x""",
    "q_bm25": "WITH q AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS words FROM benchmark), r AS (SELECT doc_id AS record_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS words FROM documents),"
    + _BM25.format(pool="", stats="CROSS JOIN st") + _top_sql("FROM s", 10).replace("(FROM s)", "s"),
    "q_bm25_pools": "WITH c AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9'']+') AS words FROM conversations), q AS (SELECT conv_id AS query_id, conv_id, words FROM c WHERE turn = 0), r AS (SELECT conv_id * 1000 + turn AS record_id, conv_id, words FROM c WHERE turn > 0),"
    + _BM25.format(pool="conv_id,", stats="JOIN st USING (conv_id)") + _top_sql("FROM s", 3).replace("(FROM s)", "s"),
    "q_lexical_rag": f"""WITH {_SETS}, qq AS (SELECT query_id, query, {terms_sql("query")} AS qx FROM q), rr AS (SELECT record_id, entity, attribute, {terms_sql("text")} AS rx FROM r) """
    + _top_sql("""SELECT query_id, record_id, round(len(list_intersect(qx, rx)) / sqrt(greatest(1, len(qx) * len(rx))::DOUBLE) + CASE WHEN length(entity) >= 4 AND contains(lower(query), lower(entity)) THEN 5.0 ELSE 0 END
        + CASE WHEN attribute <> '' AND contains(lower(query), lower(attribute)) THEN 1.0 ELSE 0 END, 6) AS score FROM c JOIN qq USING (query_id) JOIN rr USING (record_id)""", 5),
    "q_record_scores": f"WITH {_SCORED} SELECT query_id, record_id, " + ", ".join(f"round({n}, 6) AS {n}" for n in ("s_routed", "s_lexical", "s_overlap", "s_quality", "s_rare", "s_shape", "s_structured", "s_entity", "s_attribute", "score")) + " FROM z",
    "q_page_scores": f"WITH {_SCORED} " + _top_sql("""SELECT query_id, entity AS page_id, round(max(s_routed) + CASE WHEN bool_or(has_tokens) THEN 0.2::DOUBLE ELSE 0 END + 0.025::DOUBLE + 0.01::DOUBLE + 1.1::DOUBLE * max(lexical) + 1.25::DOUBLE * max(rare)
        + CASE WHEN bool_or(s_entity > 0) THEN 2.5 ELSE 0 END + CASE WHEN bool_or(s_attribute > 0) THEN 0.75 ELSE 0 END + 0.45::DOUBLE * max(overlap), 6) AS score FROM z GROUP BY ALL""", 3, "page_id"),
    "q_read_gates": f"""
        WITH {_SCORED}, k AS (SELECT query_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rk FROM z),
        b AS (SELECT query_id, max(score) FILTER (rk = 1) AS top1, max(score) FILTER (rk = 2) AS top2 FROM k GROUP BY ALL),
        g AS (SELECT query_id, record_id, count(*) AS n_terms, bool_or(regexp_full_match(term, '[a-z_]*') AND ({_ADDRESS} OR {_SYMBOL} OR {_VALUE})) AS telling, bool_or(regexp_full_match(term, '[a-z_]*')) AS letters FROM sh WHERE df <= 64 GROUP BY ALL),
        h AS (SELECT query_id, max(n_terms) AS st FROM g WHERE telling OR (letters AND n_terms >= 2) OR n_terms >= 3 GROUP BY ALL),
        a AS (SELECT q.query_id, top1, coalesce(top1, 0) - coalesce(top2, 0) AS margin, coalesce(st, 0) AS st, coalesce(st, 0) > 8 AS ev, q.query_id % 10 / 10.0 AS need,
              CASE WHEN q.query_id % 4 = 0 THEN q.query_id % 8 = 0 END AS covered, q.query_id % 3 <> 0 AS known FROM q LEFT JOIN b USING (query_id) LEFT JOIN h USING (query_id)),
        w AS (SELECT *, CASE WHEN covered IS NOT NULL AND NOT known THEN 'no_attribute_recognised' WHEN NOT covered THEN 'attribute_not_covered' WHEN need < 0.65 AND NOT ev THEN 'router_abstained'
              WHEN top1 IS NULL THEN 'no_relevant_evidence' WHEN margin < 0.05 AND NOT ev THEN 'insufficient_evidence_margin' WHEN top1 < 0.65 AND st >= 3 THEN 'token_evidence_override'
              WHEN top1 < 0.65 AND NOT ev THEN 'below_read_threshold' ELSE 'evidence_found' END AS stop_reason FROM a)
        SELECT query_id, stop_reason, stop_reason IN ('evidence_found', 'token_evidence_override') AS reads, round(margin, 6) AS margin, round(least(1.0, greatest(0.0, coalesce(top1, 0))), 6) AS confidence FROM w""",
    **dict.fromkeys(("q_dense_topk", "q_dense_exact_topk", "q_dense_index_topk"), f"WITH {_EVERY} " + _top_sql("SELECT query_id, record_id, round(cosine, 6) AS score FROM n", 5)),
    "q_signature_probe": f"WITH {_VECTORS} " + _top_sql("SELECT query_id, record_id, round(cosine, 6) AS score FROM n", 5),
    "q_signatures": f"WITH {_VECTORS}, f AS (SELECT label, min_by(code, vec_id) AS fc FROM e GROUP BY label) SELECT vec_id, code, bit_count(xor(code, fc))::INT AS bits, round(sqrt({_DOT.format('v', 'v')}), 5) AS norm FROM e JOIN f USING (label)",
    "q_dense_rerank": f"""
        WITH {_EVERY}, tk AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 12) DESC, record_id) <= 8),
        x AS (SELECT query_id, record_id, cosine, lower(a.source || ' ' || a.text) AS query, {terms_sql("a.text")} AS qx, {terms_sql("b.text")} AS rx, lower(b.source) AS entity, lower(b.lang) AS attribute
              FROM tk JOIN documents a ON a.doc_id = query_id JOIN documents b ON b.doc_id = record_id) """
    + _top_sql("""SELECT query_id, record_id, round(0.35::DOUBLE * ((cosine + 1) * 0.5::DOUBLE) + 0.15::DOUBLE * (len(list_intersect(qx, rx)) / sqrt(greatest(1, len(qx) * len(rx))::DOUBLE))
        + CASE WHEN entity <> '' AND contains(query, entity) THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN attribute <> '' AND contains(query, attribute) THEN 0.2::DOUBLE ELSE 0 END, 6) AS score FROM x""", 3),
    "q_dense_rerank_united": f"""
        WITH d AS MATERIALIZED (SELECT vec_id AS id, embedding AS v, concat_ws(' ', source, text) AS query, lower(trim(source)) AS entity, lower(trim(lang)) AS attribute, {terms_sql("text")} AS t FROM embeddings JOIN documents ON doc_id = vec_id),
        n AS MATERIALIZED (SELECT a.id AS query_id, b.id AS record_id, {_DOT.format("a.v", "b.v")} / (sqrt({_DOT.format("a.v", "a.v")}) * sqrt({_DOT.format("b.v", "b.v")})) AS cosine FROM d a JOIN d b ON a.id <> b.id WHERE a.id % 20 = 0),
        k AS (SELECT query_id, record_id FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 12) DESC, record_id) <= 32),
        w AS (SELECT id, unnest(t) AS term FROM d), few AS (SELECT term FROM w GROUP BY term HAVING count(*) <= 256),
        l AS (SELECT DISTINCT a.id AS query_id, b.id AS record_id FROM w a JOIN few USING (term) JOIN w b USING (term) WHERE a.id % 20 = 0),
        g AS (SELECT id, entity AS x FROM d WHERE length(entity) >= 4 AND entity IN (SELECT entity FROM d GROUP BY entity HAVING count(*) <= 512)
              UNION SELECT id, attribute FROM d WHERE length(attribute) >= 4 AND attribute IN (SELECT attribute FROM d GROUP BY attribute HAVING count(*) <= 512)),
        c AS (SELECT * FROM k UNION SELECT * FROM l UNION SELECT d.id, g.id FROM d JOIN g ON contains(lower(trim(d.query)), g.x) WHERE d.id % 20 = 0),
        x AS (SELECT query_id, record_id, cosine, lower(a.query) AS query, a.t AS qx, b.t AS rx, coalesce(b.entity, '') AS entity, coalesce(b.attribute, '') AS attribute
              FROM c JOIN n USING (query_id, record_id) JOIN d a ON a.id = query_id JOIN d b ON b.id = record_id) """
    + _top_sql("""SELECT query_id, record_id, round(0.35::DOUBLE * ((cosine + 1) * 0.5::DOUBLE) + 0.15::DOUBLE * (len(list_intersect(qx, rx)) / sqrt(greatest(1, len(qx) * len(rx))::DOUBLE))
        + CASE WHEN entity <> '' AND contains(query, entity) THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN attribute <> '' AND contains(query, attribute) THEN 0.2::DOUBLE ELSE 0 END, 6) AS score FROM x""", 3),
    "q_chunk_overlap": f"""
        WITH c AS (SELECT doc_id, unnest(range(0, ceil(length(text) / 1800.0)::BIGINT)) AS i, text FROM documents),
        k AS (SELECT doc_id * 1000 + i AS chunk_id, unnest({terms_sql("trim(substr(text, i * 1800 + 1, 1800))")}) AS term FROM c),
        q AS (SELECT item_id AS query_id, unnest({terms_sql("text")}) AS term FROM benchmark) """
    + _top_sql("SELECT query_id, chunk_id, count(*) AS score FROM k JOIN q USING (term) GROUP BY ALL", 3, "chunk_id"),
    "q_hops": """
        WITH RECURSIVE a AS (SELECT conv_id * 1000 + turn AS id FROM conversations),
        g AS (SELECT id, unnest([id + 1, id + id % 1000]) AS nx FROM a), e AS (SELECT DISTINCT id, nx FROM g WHERE nx IN (SELECT id FROM a)),
        w AS (SELECT conv_id AS query_id, conv_id * 1000 AS record_id, 0 AS hop FROM conversations WHERE turn = 0
              UNION SELECT query_id, nx, hop + 1 FROM w JOIN e ON e.id = w.record_id WHERE hop < 3)
        SELECT query_id, record_id, min(hop) AS hop FROM w GROUP BY ALL""",
    "q_evidence_chain": """
        WITH f AS (SELECT conv_id AS g, turn AS seq, lower(text) AS text, lower(regexp_extract(text, '^([A-Za-z]+)', 1)) AS value FROM conversations),
        o AS (SELECT a.g, a.seq, b.seq AS n1, b.text AS t1 FROM f a JOIN f b ON a.g = b.g AND b.seq <> a.seq AND b.value <> '' AND contains(a.text, b.value)),
        p AS (SELECT o.g, o.seq, o.n1, b.seq AS n2, b.text AS t2 FROM o JOIN f b ON o.g = b.g AND b.seq NOT IN (o.seq, o.n1) AND b.value <> '' AND contains(o.t1, b.value)),
        l AS (SELECT p.g, p.seq, b.seq AS n3 FROM p JOIN f b ON p.g = b.g AND b.seq NOT IN (p.seq, p.n1, p.n2) AND b.value <> '' AND contains(p.t2, b.value)),
        u AS (SELECT g, seq, n1 AS nx, 1 AS hop FROM o UNION ALL SELECT g, seq, n2, 2 FROM p UNION ALL SELECT g, seq, n3, 3 FROM l)
        SELECT g AS group_id, seq, nx AS next_seq, min(hop) AS hop FROM u GROUP BY ALL""",
    "q_centroids": "SELECT label, i::INT AS dim, round(avg(x), 5) AS x FROM (SELECT label, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL",
}
