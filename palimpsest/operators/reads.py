"""The whole read of a query: addresses and evidence first, else pages, their records and what those link to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..sources.files import held
from . import retrieval as R
from . import vector_index as X

#: Scores of records found by address and by evidence, pages below which none is left out, postings of a page term.
ADDRESS_SCORE, EVIDENCE_SCORE, FEW_PAGES, PAGE_TERM_CAP = 10.0, 8.0, 128, 128
#: Pages of the nearest vectors that are scored.
NEAR_PAGES = 32
#: Records that a query with a name gets at least, if so many match.
DIRECT_RECORDS = 8


def candidate_pages(
    queries: DataFrame, records: DataFrame, pages: DataFrame, few: int = FEW_PAGES, near: int = NEAR_PAGES, dims: int = 64, cap: int = PAGE_TERM_CAP, post: DataFrame | None = None,
    address: DataFrame | None = None, target: float = 0.99,
) -> DataFrame:
    """(query_id, page_id): the pages that are worth a score.

    All of them if there are at most `few`. Else the `near` nearest by a vector index whose probes hold
    `target` of them on its sample, those of terms that at most `cap` pages or `cap` records have, those
    of address hits and the hot ones; a query without any gets the first `few`. queries has query_id,
    tokens and vector; records record_id, page_id, entity, attribute, value and tokens; pages page_id,
    vector and tier, of which few are hot. post (term, record_id, page_id) and address are the asked
    postings and address hits, where the caller has them. Only ids of `few` pages, the hot ones and
    the index's centroids come to the driver.
    """
    first = [r.page_id for r in pages.select("page_id").orderBy("page_id").limit(few + 1).collect()]
    with_all = lambda ids: queries.select("query_id", F.explode(F.array(*map(F.lit, ids))).alias("page_id"))
    if len(first) <= few:
        return with_all(first) if first else queries.join(pages.select("page_id"), F.lit(False)).select("query_id", "page_id")
    closest = X.nearest(queries, pages.withColumnRenamed("page_id", "record_id"), near, target=target, dims=dims, apart=False).select("query_id", F.col("record_id").alias("page_id"))
    post = held(R.asked_postings(queries, records, "page_id")) if post is None else post
    address = R.address_hits(queries, records) if address is None else address.join(queries.select("query_id"), "query_id", "left_semi")
    home = records.select("record_id", "page_id")
    own = post.select("term", "page_id").distinct()
    by_page = own.join(R.capped(own, cap), "term").join(R.postings(queries, "query_id"), "term").select("query_id", "page_id")
    by_record = R.lexical_candidates(queries, records, cap, post).union(address).join(home, "record_id").select("query_id", "page_id")
    hot = [r.page_id for r in pages.where("tier = 'hot'").select("page_id").collect()]
    found = closest.union(by_page).union(by_record)
    found = (found.union(with_all(hot)) if hot else found).distinct()
    return found.union(with_all(first[:few]).join(found, "query_id", "left_anti"))


def _scored(front: DataFrame, queries: DataFrame, records: DataFrame, rare: DataFrame) -> DataFrame:
    """Records of the pages (query_id, page_id) with the terms of their score."""
    pairs = front.join(queries.select("query_id", "query", F.col("tokens").alias("q_tokens"), F.col("vector").alias("q_vector")), "query_id")
    pairs = pairs.join(records.withColumnsRenamed({"tokens": "r_tokens", "vector": "r_vector"}), "page_id")
    return R.record_scores(pairs.withColumn("routed", V.cosine(F.col("q_vector"), F.col("r_vector"))), rare)


def _best_pages(candidates: DataFrame, queries: DataFrame, records: DataFrame, pages: DataFrame, rare: DataFrame, most: int, least: float, digits: int) -> DataFrame:
    rows = _scored(candidates, queries, records, rare).join(pages.select("page_id", F.col("vector").alias("p_vector"), F.col("importance").alias("page_importance"), "age_hours"), "page_id")
    rows = rows.select(
        "query_id", "page_id", V.cosine(F.col("q_vector"), F.col("p_vector")).alias("routed"), (F.size("r_tokens") > 0).alias("has_tokens"), "page_importance", "age_hours",
        T.lexical_score(F.col("q_tokens"), F.col("r_tokens")).alias("lexical"), (F.col("s_rare") / R.WEIGHTS["rare_lexical"]).alias("rare"), (F.col("s_entity") > 0).alias("entity_hit"),
        (F.col("s_attribute") > 0).alias("attribute_hit"), (F.col("s_overlap") / R.WEIGHTS["token_overlap"]).alias("overlap"),
    )
    scored = R.page_scores(rows).withColumn("score", F.round("score", digits)).where(F.col("score") >= least)
    return R.top_k(scored, most, tie="page_id").select("query_id", "page_id")


def _agrees(rows: DataFrame) -> Column:
    return R.matches_address(F.col("query"), F.col("q_tokens"), F.col("entity"), F.col("attribute"), F.col("value"))


def _is_symbol(attribute: Column) -> Column:
    a = F.lower(F.trim(attribute))
    return a.startswith("symbol:") | a.startswith("class:") | a.startswith("def:")


def read(
    queries: DataFrame, records: DataFrame, pages: DataFrame, edges: DataFrame, k: int = 5, most_pages: int = 4, most_hops: int = 3, least: float = -1.0, few: int = FEW_PAGES, near: int = NEAR_PAGES,
    dims: int = 64, digits: int = 6, target: float = 0.99,
) -> DataFrame:
    """(query_id, record_id, path, hop, score, rank): the records that each query reads.

    A query whose names or telling terms hit records reads those (path direct). Any other reads the
    records of its best pages (path pages), and while it has fewer than k, those of the pages that
    the last ones link to, up to most_hops rounds. If any record read answers to the names in the
    query, only such stay. k records are read; eight, if a direct one is a symbol. Scores are rounded;
    ties go to the lower id. Each step is computed once (files.held), so plans don't grow with the rounds.

    queries has query_id, query, tokens and vector; records record_id, page_id, entity, attribute,
    value, tokens, vector, confidence and importance, active ones only; pages page_id, vector, tier,
    importance and age_hours; edges record_id and related_id. All joins are on ids or capped terms.
    """
    q = queries.select("query_id", "query", F.col("tokens").alias("q_tokens"))
    address = held(R.address_hits(queries, records))
    post = held(R.asked_postings(queries, records, "page_id"))  # the records' terms are taken apart once
    evidence = held(R.evidence_hits(queries, records, post=post).select("query_id", "record_id"))
    content = evidence.join(address, ["query_id", "record_id"], "left_anti")
    hits = address.withColumn("base", F.lit(ADDRESS_SCORE)).union(content.withColumn("base", F.lit(EVIDENCE_SCORE)))
    own = records.select("record_id", "entity", "attribute", "value", F.col("tokens").alias("r_tokens"))
    hits = hits.join(q, "query_id").join(own, "record_id")
    hits = hits.withColumn("agrees", _agrees(hits)).where((F.col("base") == EVIDENCE_SCORE) | F.col("agrees"))
    structured = (F.col("entity") != "") | (F.col("attribute") != "") | (F.col("value") != "")
    score = (
        F.col("base") + R.WEIGHTS["lexical"] * T.lexical_score(F.col("q_tokens"), F.col("r_tokens")) + F.when(F.size("r_tokens") > 0, R.WEIGHTS["shape_bonus"]).otherwise(0.0)
        + F.when(structured, R.WEIGHTS["structured_bonus"]).otherwise(0.0)
    )
    symbol = F.bool_or(_is_symbol(F.col("attribute"))).over(W.partitionBy("query_id"))
    direct = R.top_k(hits.select("query_id", "record_id", F.round(score, digits).alias("score"), "agrees", symbol.alias("symbol")), max(k, DIRECT_RECORDS))
    direct = held(direct.select("query_id", "record_id", F.lit("direct").alias("path"), F.lit(0).alias("hop"), "score", "agrees", "symbol"))

    rest = held(queries.join(direct, "query_id", "left_anti"))
    home = records.select("record_id", "page_id")
    routed = address.union(evidence).join(rest.select("query_id"), "query_id", "left_semi").join(home, "record_id").select("query_id", "page_id").distinct()
    open_ = rest.join(routed, "query_id", "left_anti")
    rare = held(R.rare_scores(rest, records, post=post))
    candidates = held(candidate_pages(open_, records, pages, few, near, dims, post=post, address=address, target=target))
    front = held(routed.union(_best_pages(candidates, open_, records, pages, rare, most_pages, least, digits)))
    found = None
    for hop in range(most_hops):
        scored = _scored(front, rest, records, rare)
        scored = scored.withColumns({"agrees": _agrees(scored), "score": F.round("score", digits)}).select("query_id", "record_id", "score", "agrees")
        room = F.lit(k)
        if found is not None:
            scored = scored.join(found, ["query_id", "record_id"], "left_anti").join(found.groupBy("query_id").agg(F.count("*").alias("_n")), "query_id", "left")
            room = k - F.coalesce("_n", F.lit(0))
        new = R.top_k(scored.withColumn("_room", room), k).where(F.col("rank") <= F.col("_room"))
        new = held(new.select("query_id", "record_id", F.lit("pages").alias("path"), F.lit(hop).alias("hop"), "score", "agrees", F.lit(False).alias("symbol"), "rank"))
        linked = new.join(edges, "record_id").select("query_id", "rank", F.col("related_id").alias("record_id")).join(home, "record_id").groupBy("query_id", "page_id").agg((-F.min("rank")).alias("score"))
        front = R.top_k(linked, most_pages, tie="page_id").select("query_id", "page_id")
        found = new.drop("rank") if found is None else found.union(new.drop("rank"))
    w = W.partitionBy("query_id")
    out = direct.union(found).withColumns({"_any": F.bool_or("agrees").over(w), "_most": F.when(F.bool_or("symbol").over(w), max(k, DIRECT_RECORDS)).otherwise(k)})
    ranked = R.top_k(out.where("agrees or not _any"), max(k, DIRECT_RECORDS))
    return ranked.where(F.col("rank") <= F.col("_most")).select("query_id", "record_id", "path", "hop", "score", "rank")
