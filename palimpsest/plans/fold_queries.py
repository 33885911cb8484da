"""Folds whose steps depend on those before: versions where an equal text wins, and slot banks with two matchers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folds
from ..operators.learned import PairMlp
from ..operators.placement import consolidate, place
from ..sources.files import read_table
from .learned_queries import small_layers
from .retrieval_queries import _DOT


def document_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a log: each replaces the one before of its source, language and size; every tenth takes that one back."""
    d = read_table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 10 == 9, "retract").otherwise("write").alias("op"), F.col("source").alias("entity"),
        F.concat_ws(":", "lang", F.floor(F.col("n_chars") / 1000).cast("string")).alias("attribute"), F.col("n_chars").cast("string").alias("value"), "text",
    )


def q_ledger_text_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of the documents' log; copies of an active document are its duplicates, whatever their source."""
    out = folds.text_first_versions(document_log(spark, sf_dir))
    return out.select("seq", "entity", "attribute", "action", "version", "status", "supersedes", "duplicate_of")


def event_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of each user: the words of their type, value and properties, a vector, and a fact for two types."""
    e, v = read_table(spark, sf_dir, "events"), read_table(spark, sf_dir, "embeddings")
    n = v.agg((F.max("vec_id") + 1).alias("_n"))
    fact = F.when(F.col("event_type").isin("click", "view"), F.concat_ws("::", F.col("user_id").cast("string"), "event_type"))
    words = F.array("event_type", F.concat(F.lit("v"), (F.floor(F.col("value") / 50)).cast("string")), F.regexp_replace("props", "[^a-z0-9]+", ""))
    rows = e.crossJoin(F.broadcast(n)).select(  # one row
        "user_id", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "forget").otherwise("write").alias("op"), words.alias("tokens"), fact.alias("fact"), (F.col("event_id") % F.col("_n")).alias("vec_id")
    )
    return rows.join(v.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")), "vec_id", "left").drop("vec_id")


def slot_scorer() -> PairMlp:
    (w, b), (out, c) = small_layers()
    return PairMlp(((w * 8, b), (out * 40, np.asarray(c))))


def q_slot_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events folded into six slots, matched by token overlap and a fixed network; a sequential rule that SQL can't say."""
    out = folds.slot_bank(event_slots(spark, sf_dir), 6, slot_scorer())
    return out.withColumns({"overlap": F.round("overlap", 6), "learned": F.round("learned", 6)})


PAGE_ROWS, PAGE_ROOM, STAY, CAPACITY = 16, 20, 20, 32


def q_ledger_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on pages around every sixteenth of them, twenty to a page at most, each on the nearest with room."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    pages = e.where(f"vec_id % {PAGE_ROWS} = 0").select(F.col("vec_id").alias("page_id"), "vector", F.lit(PAGE_ROOM).alias("room"))
    return place(e.withColumnRenamed("vec_id", "record_id"), pages, target=1.0)


def q_ledger_consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by number merged into twenty, or as many as all vectors need, and where each record is then."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    records = e.select(F.col("vec_id").alias("record_id"), (F.col("vec_id") - F.col("vec_id") % PAGE_ROWS).alias("page_id"), "vector")
    pages = e.where(f"vec_id % {PAGE_ROWS} = 0").select(F.col("vec_id").alias("page_id"), "vector", (F.col("vec_id") * 7 % 11 / 11).alias("importance"))
    return consolidate(records, pages, STAY, CAPACITY, align=1.0)


QUERIES = {f.__name__: f for f in (q_ledger_text_first, q_slot_bank, q_ledger_placed, q_ledger_consolidated)}


def placed_sql(rounds: int = 40) -> str:
    """CTEs that place w (record_id, v) on p (page_id, v, room): a few for each round; `placed` is what all took."""
    steps = [
        f"""x AS MATERIALIZED (SELECT w.record_id, p.page_id, round({_DOT.format("w.v", "p.v")} / (sqrt({_DOT.format("w.v", "w.v")}) * sqrt({_DOT.format("p.v", "p.v")})), 6) AS score FROM w, p),
        t0 AS MATERIALIZED (SELECT NULL::BIGINT AS record_id, NULL::BIGINT AS page_id, NULL::DOUBLE AS score WHERE false)"""
    ]
    for i in range(rounds):
        steps.append(
            f"""r{i} AS (SELECT page_id, room - count(t.record_id) AS room FROM p LEFT JOIN t{i} t USING (page_id) GROUP BY page_id, room),
            o{i} AS (SELECT record_id, page_id, score, room FROM x JOIN r{i} USING (page_id) ANTI JOIN t{i} USING (record_id) WHERE room > 0 QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY score DESC, page_id) = 1),
            t{i + 1} AS MATERIALIZED (SELECT * FROM t{i} UNION ALL SELECT record_id, page_id, score FROM o{i} QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, record_id) <= max(room) OVER (PARTITION BY page_id))"""
        )
    return ", ".join(steps) + f", placed AS (SELECT * FROM t{rounds})"


SQL = {
    "q_ledger_placed": f"""
        WITH w AS (SELECT vec_id AS record_id, embedding AS v FROM embeddings), p AS (SELECT vec_id AS page_id, embedding AS v, {PAGE_ROOM} AS room FROM embeddings WHERE vec_id % {PAGE_ROWS} = 0),
        {placed_sql()} SELECT record_id, page_id, score FROM placed""",
    "q_ledger_consolidated": f"""
        WITH e AS (SELECT vec_id AS record_id, vec_id - vec_id % {PAGE_ROWS} AS page_id, embedding AS v FROM embeddings), z AS (SELECT page_id, count(*) AS n FROM e GROUP BY page_id),
        s AS MATERIALIZED (SELECT vec_id AS page_id, embedding AS v FROM embeddings JOIN z ON page_id = vec_id WHERE vec_id % {PAGE_ROWS} = 0
              ORDER BY vec_id * 7 % 11 DESC, n DESC, vec_id LIMIT (SELECT greatest({STAY}, (count(*) + {CAPACITY - 1}) // {CAPACITY}) FROM embeddings)),
        k AS MATERIALIZED (SELECT record_id, page_id FROM e JOIN s USING (page_id) QUALIFY row_number() OVER (PARTITION BY page_id
              ORDER BY round({_DOT.format("e.v", "s.v")} / (sqrt({_DOT.format("e.v", "e.v")}) * sqrt({_DOT.format("s.v", "s.v")})), 6) DESC, record_id) <= {CAPACITY}),
        w AS (SELECT record_id, v FROM e ANTI JOIN k USING (record_id)), p AS (SELECT s.page_id, s.v, {CAPACITY} - count(k.record_id) AS room FROM s LEFT JOIN k USING (page_id) GROUP BY ALL),
        {placed_sql()} SELECT record_id, page_id, false AS moved FROM k UNION ALL SELECT record_id, page_id, true FROM placed""",
    "q_ledger_text_first": """
        WITH RECURSIVE d AS (SELECT doc_id AS seq, doc_id % 10 = 9 AS retract, source AS entity, concat_ws(':', lang, (n_chars // 1000)::VARCHAR) AS attribute, n_chars::VARCHAR AS v, lower(trim(text)) AS t FROM documents),
        l AS (SELECT *, CASE WHEN trim(entity) <> '' AND trim(attribute) <> '' THEN lower(trim(entity)) || '::' || lower(trim(attribute)) END AS k, row_number() OVER (ORDER BY seq) AS i FROM d),
        w AS (SELECT i, seq, retract, k, coalesce(v, '') AS v, CASE WHEN t <> '' THEN sha256(t) END AS t FROM l),
        f AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS seq, NULL::VARCHAR AS action, NULL::INT AS version, NULL::BIGINT AS ref, []::STRUCT(seq BIGINT, k VARCHAR, v VARCHAR, t VARCHAR, n INT)[] AS live
          UNION ALL
          SELECT i, seq, CASE WHEN retract THEN 'retract' WHEN same IS NOT NULL THEN 'duplicate' WHEN old IS NOT NULL THEN 'updated' ELSE 'inserted' END,
                 CASE WHEN retract THEN NULL WHEN same IS NOT NULL THEN same.n ELSE coalesce(old.n + 1, 0) END, CASE WHEN NOT retract AND same IS NOT NULL THEN same.seq ELSE old.seq END,
                 CASE WHEN NOT retract AND same IS NOT NULL THEN live
                      WHEN retract THEN list_filter(live, lambda x: old IS NULL OR x.seq <> old.seq)
                      ELSE list_append(list_filter(live, lambda x: old IS NULL OR x.seq <> old.seq), {'seq': seq, 'k': k, 'v': v, 't': t, 'n': coalesce(old.n + 1, 0)::INT}) END
          FROM (SELECT *, coalesce(twin, CASE WHEN old.v = v THEN old END) AS same FROM (
                SELECT w.i, w.seq, retract, w.k, w.v, w.t, live, list_filter(live, lambda x: x.k = w.k)[1] AS old, list_filter(live, lambda x: x.t = w.t)[1] AS twin FROM f JOIN w ON w.i = f.i + 1))),
        e AS (SELECT ref AS seq, max(CASE WHEN action = 'updated' THEN 'superseded' ELSE 'retracted' END) AS ended FROM f WHERE action IN ('updated', 'retract') AND ref IS NOT NULL GROUP BY ref)
        SELECT seq, entity, attribute, action, version, CASE WHEN action IN ('inserted', 'updated') THEN coalesce(ended, 'active') END AS status,
               CASE WHEN action = 'updated' THEN ref END AS supersedes, CASE WHEN action = 'duplicate' THEN ref END AS duplicate_of
        FROM f JOIN l USING (i, seq) LEFT JOIN e USING (seq)""",
}
