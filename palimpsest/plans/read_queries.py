"""The whole read: benchmark items, in full or their first words, against documents with vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import reads as RD
from ..sources.files import held, read_spread, read_table
from .retrieval_queries import _ADDRESS, _DOT, _SYMBOL, _VALUE, DIMS
from .text_queries import lexical_sql, tokens_sql

PAGE_ROWS, FEW, HOT, NEAR = 8, 16, 2, 8


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Queries, records, pages of eight neighbours, and links from a record to the ninth after it and to twice its number."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    words = T.bm25_words(F.col("text"))
    asked = F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise(F.array_join(F.slice(words, 1, 3), " "))
    q = read_table(spark, sf_dir, "benchmark").select("item_id", asked.alias("query")).join(e.withColumnRenamed("vec_id", "item_id"), "item_id")
    q = held(q.select(F.col("item_id").alias("query_id"), "query", T.tokens(F.col("query")).alias("tokens"), "vector"))
    word = lambda i: F.coalesce(F.get(words, F.lit(i)), F.lit(""))
    d = read_spread(spark, sf_dir, "documents").select(
        "doc_id", word(2).alias("entity"), F.concat(F.when(F.col("doc_id") % 3 == 0, "symbol:").otherwise(""), word(3)).alias("attribute"), word(4).alias("value"), T.tokens(F.col("text")).alias("tokens")
    )
    r = held(d.join(e.withColumnRenamed("vec_id", "doc_id"), "doc_id").select(
        F.col("doc_id").alias("record_id"), F.floor(F.col("doc_id") / PAGE_ROWS).alias("page_id"), "entity", "attribute", "value", "tokens", "vector",
        (F.col("doc_id") % 10 / 10).alias("confidence"), (F.col("doc_id") % 4 / 4).alias("importance"),
    ))
    p = r.where(F.col("record_id") % PAGE_ROWS == 0).select(
        "page_id", "vector", F.when(F.col("page_id") < HOT, "hot").otherwise("cold").alias("tier"), (F.col("page_id") % 5 / 5).alias("importance"), (F.col("page_id") % 3).cast("double").alias("age_hours")
    )
    id_ = F.col("record_id")
    return q, r, p, r.select("record_id", F.explode(F.array(id_ + 9, id_ * 2)).alias("related_id"))


def q_candidate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages each item's read would score, and the least and largest of them."""
    q, r, p, _ = _tables(spark, sf_dir)
    return RD.candidate_pages(q, r, p, FEW, NEAR, DIMS, 16, target=1.0).groupBy("query_id").agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"), F.max("page_id").alias("last_page"))


def q_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that each item reads: direct ones, or those of its best page and of linked pages."""
    q, r, p, edges = _tables(spark, sf_dir)
    return RD.read(q, r, p, edges, k=10, most_pages=1, few=FEW, near=NEAR, dims=DIMS, target=1.0)


QUERIES = {f.__name__: f for f in (q_candidate_pages, q_read)}

_LOW = "regexp_extract_all(lower(text), '[a-z0-9'']+')"
_BASE = rf"""
    q0 AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN text ELSE array_to_string(({_LOW})[1:3], ' ') END AS query FROM benchmark),
    q AS MATERIALIZED (SELECT query_id, query, {tokens_sql("query")} AS tokens, embedding AS v FROM q0 JOIN embeddings ON vec_id = query_id),
    w AS (SELECT doc_id, text, {_LOW} AS w FROM documents),
    r AS MATERIALIZED (SELECT doc_id AS record_id, doc_id // {PAGE_ROWS} AS page_id, coalesce(w[3], '') AS entity, CASE WHEN doc_id % 3 = 0 THEN 'symbol:' ELSE '' END || coalesce(w[4], '') AS attribute, coalesce(w[5], '') AS value,
          {tokens_sql("text")} AS tokens, embedding AS v, doc_id % 10 / 10.0::DOUBLE AS confidence, doc_id % 4 / 4.0::DOUBLE AS importance FROM w JOIN embeddings ON vec_id = doc_id),
    pg AS (SELECT page_id, v, page_id < {HOT} AS hot, page_id % 5 / 5.0::DOUBLE AS importance, (page_id % 3)::DOUBLE AS age FROM r WHERE record_id % {PAGE_ROWS} = 0),
    qt AS (SELECT query_id, unnest(tokens) AS term FROM q), rt AS (SELECT record_id, page_id, unnest(tokens) AS term FROM r),
    df AS (SELECT term, count(*) AS df, count(DISTINCT page_id) AS pages FROM rt GROUP BY term),
    sh AS MATERIALIZED (SELECT query_id, record_id, page_id, term, df, pages FROM rt JOIN df USING (term) JOIN qt USING (term)),
    k AS (SELECT *, {tokens_sql("entity")} AS ek, {tokens_sql("attribute")} AS ak, {tokens_sql("value")} AS vk FROM r),
    nm AS (SELECT DISTINCT record_id, term FROM (SELECT record_id, unnest({tokens_sql("entity || ' ' || attribute")}) AS term FROM r) WHERE {_ADDRESS} OR {_SYMBOL}),
    vl AS (SELECT record_id, term FROM (SELECT record_id, unnest(vk) AS term FROM k) WHERE {_VALUE}),
    ad AS MATERIALIZED (SELECT query_id, record_id FROM nm JOIN qt USING (term) WHERE term IN (SELECT term FROM nm GROUP BY term HAVING count(*) <= 256)
           UNION SELECT query_id, record_id FROM vl JOIN qt USING (term) WHERE term IN (SELECT term FROM vl GROUP BY term HAVING count(*) <= 128))"""
_COS = lambda a, b: f"({_DOT.format(a, b)} / (sqrt({_DOT.format(a, a)}) * sqrt({_DOT.format(b, b)})))"
_PAGES = f"""
    cl AS (SELECT q.query_id, pg.page_id, round({_COS("q.v", "pg.v")}, 6) AS c FROM q, pg QUALIFY row_number() OVER (PARTITION BY q.query_id ORDER BY c DESC, page_id) <= {NEAR}),
    cp0 AS (SELECT query_id, page_id FROM cl UNION SELECT query_id, page_id FROM sh WHERE pages <= {{cap}} OR df <= {{cap}}
            UNION SELECT query_id, page_id FROM ad JOIN r USING (record_id) UNION SELECT query_id, page_id FROM q, pg WHERE hot),
    cold AS (SELECT page_id FROM pg ORDER BY page_id LIMIT {FEW}),
    cp AS MATERIALIZED (SELECT query_id, page_id FROM q, pg WHERE (SELECT count(*) FROM pg) <= {FEW} UNION SELECT query_id, page_id FROM cp0 WHERE (SELECT count(*) FROM pg) > {FEW}
           UNION SELECT query_id, page_id FROM q, cold WHERE query_id NOT IN (SELECT query_id FROM cp0))"""
_AGREES = rf"""(SELECT CASE WHEN z.entity = '' THEN false WHEN fm AND sy AND NOT em THEN false WHEN NOT em AND NOT am AND NOT vm THEN false WHEN NOT em AND (vm OR (am AND sy)) THEN true WHEN z.attribute = '' THEN em OR vm
        ELSE em AND (am OR vm) END FROM (SELECT contains(lower(z.query), z.entity) OR len(list_filter(z.ek, lambda term: list_contains(z.qk, term) AND {_ADDRESS})) > 0 AS em,
        (z.attribute <> '' AND contains(lower(z.query), z.attribute)) OR len(list_filter(z.ak, lambda term: list_contains(z.qk, term) AND ({_ADDRESS} OR (starts_with(z.attribute, 'symbol:') AND {_SYMBOL})))) > 0 AS am,
        len(list_filter(z.vk, lambda term: list_contains(z.qk, term) AND {_VALUE})) > 0 AS vm, starts_with(z.attribute, 'symbol:') AS sy, regexp_matches(lower(z.query), '(?:[a-z0-9_.\\/-]+)\.(?:py|md|json|toml|yaml|yml)') AS fm))"""
_PAIRS = f"""SELECT q.query_id, q.query, q.tokens AS qk, k.*, {_COS("q.v", "k.v")} AS routed, {lexical_sql("q.tokens", "k.tokens")} AS lexical,
        CASE WHEN len(q.tokens) = 0 THEN 0.0 ELSE len(list_intersect(q.tokens, k.tokens))::DOUBLE / len(q.tokens) END AS overlap, coalesce(rare, 0.0)::DOUBLE AS rare,
        CASE WHEN length(k.entity) >= 4 AND contains(lower(trim(q.query)), k.entity) THEN 1 ELSE 0 END AS named,
        CASE WHEN length(k.entity) >= 4 AND contains(lower(trim(q.query)), k.entity) AND k.attribute <> '' AND contains(lower(trim(q.query)), k.attribute) THEN 1 ELSE 0 END AS paired
        FROM {{front}} f JOIN q USING (query_id) JOIN k USING (page_id) LEFT JOIN rare ON rare.query_id = q.query_id AND rare.record_id = k.record_id"""
_STRUCTURED = "CASE WHEN len(tokens) > 0 THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN entity <> '' OR attribute <> '' OR value <> '' THEN 0.15::DOUBLE ELSE 0 END"


def _hop(i: int, k: int = 10) -> str:
    seen = " UNION ALL ".join(f"SELECT query_id, record_id FROM n{j}" for j in range(i)) or "SELECT -1 AS query_id, -1 AS record_id WHERE false"
    return f"""
    a{i} AS (SELECT z.*, {_AGREES} AS agrees, round(routed + 0.25::DOUBLE * lexical + 0.45::DOUBLE * overlap + 0.10::DOUBLE * confidence + 0.08::DOUBLE * importance + 1.25::DOUBLE * rare + {_STRUCTURED} + 2.5::DOUBLE * named + 0.75::DOUBLE * paired, 6) AS score
             FROM ({_PAIRS.format(front=f"f{i}")}) z),
    s{i} AS ({seen}), c{i} AS (SELECT query_id, count(*) AS n FROM s{i} GROUP BY ALL),
    n{i} AS MATERIALIZED (SELECT query_id, record_id, 'pages' AS path, {i} AS hop, score, agrees, false AS symbol, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rk
             FROM a{i} ANTI JOIN s{i} USING (query_id, record_id) LEFT JOIN c{i} USING (query_id) QUALIFY rk <= {k} - coalesce(n, 0)),
    l{i} AS (SELECT query_id, page_id, min(rk) AS rk FROM (SELECT query_id, rk, unnest([record_id + 9, record_id * 2]) AS record_id FROM n{i}) JOIN r USING (record_id) GROUP BY ALL),
    f{i + 1} AS (SELECT query_id, page_id FROM l{i} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rk, page_id) <= 1)"""


SQL = {
    "q_candidate_pages": f"WITH {_BASE}, {_PAGES.format(cap=16)} SELECT query_id, count(*) AS n_pages, min(page_id) AS first_page, max(page_id) AS last_page FROM cp GROUP BY query_id",
    "q_read": f"""
        WITH {_BASE}, {_PAGES.format(cap=128)},
        g AS (SELECT query_id, record_id, count(*) AS n, bool_or(regexp_full_match(term, '[a-z_]*') AND ({_ADDRESS} OR {_SYMBOL} OR {_VALUE})) AS telling, bool_or(regexp_full_match(term, '[a-z_]*')) AS letters FROM sh WHERE df <= 64 GROUP BY ALL),
        ev AS (SELECT query_id, record_id FROM g WHERE telling OR (letters AND n >= 2) OR n >= 3),
        hit AS (SELECT query_id, record_id, 10.0::DOUBLE AS base FROM ad UNION ALL SELECT query_id, record_id, 8.0 FROM (SELECT * FROM ev EXCEPT SELECT * FROM ad)),
        hz AS (SELECT q.query, q.tokens AS qk, k.*, query_id, base FROM hit JOIN q USING (query_id) JOIN k USING (record_id)),
        ha AS (SELECT z.*, {_AGREES} AS agrees FROM hz z),
        d AS MATERIALIZED (SELECT query_id, record_id, round(base + 0.25::DOUBLE * {lexical_sql("qk", "tokens")} + {_STRUCTURED}, 6) AS score, agrees, bool_or(starts_with(attribute, 'symbol:')) OVER (PARTITION BY query_id) AS symbol
              FROM ha WHERE base = 8 OR agrees),
        dt AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) <= 10),
        rare AS (SELECT query_id, record_id, least(2.0, count(*)::DOUBLE)::DOUBLE AS rare FROM sh WHERE df <= 32 GROUP BY ALL),
        ro AS (SELECT DISTINCT query_id, page_id FROM (SELECT * FROM ad UNION SELECT * FROM ev) JOIN r USING (record_id) WHERE query_id NOT IN (SELECT query_id FROM d)),
        op AS (SELECT query_id, page_id FROM cp WHERE query_id NOT IN (SELECT query_id FROM d) AND query_id NOT IN (SELECT query_id FROM ro)),
        pp AS ({_PAIRS.format(front="op")}),
        ps AS (SELECT query_id, page_id, round(any_value({_COS("q.v", "pg.v")}) + CASE WHEN bool_or(len(pp.tokens) > 0) THEN 0.2::DOUBLE ELSE 0 END + 0.05::DOUBLE * any_value(pg.importance) + any_value(0.02::DOUBLE / (1 + age)) + 1.1::DOUBLE * max(lexical)
               + 1.25::DOUBLE * max(rare) + 2.5::DOUBLE * max(named) + 0.75::DOUBLE * max(paired) + 0.45::DOUBLE * max(overlap), 6) AS score FROM pp JOIN q USING (query_id) JOIN pg USING (page_id) GROUP BY ALL),
        f0 AS (SELECT * FROM ro UNION ALL SELECT query_id, page_id FROM (SELECT * FROM ps WHERE score >= -1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) <= 1)),
        {_hop(0)}, {_hop(1)}, {_hop(2)},
        u AS (SELECT query_id, record_id, 'direct' AS path, 0 AS hop, score, agrees, symbol FROM dt UNION ALL SELECT * EXCLUDE rk FROM n0 UNION ALL SELECT * EXCLUDE rk FROM n1 UNION ALL SELECT * EXCLUDE rk FROM n2),
        y AS (SELECT *, bool_or(agrees) OVER (PARTITION BY query_id) AS found FROM u)
        SELECT query_id, record_id, path, hop::INT AS hop, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id)::INT AS rank FROM y WHERE agrees OR NOT found QUALIFY rank <= 10""",
}
