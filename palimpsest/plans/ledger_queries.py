"""The ledger over the events table, and over documents and conversations as records.

An event is a write of (user, type) with its value in tens; an error event retracts one of the
other types of its user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ledger as L
from ..sources.files import read_table

TYPES = ("click", "purchase", "signup", "view")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, op, entity, attribute, value, confidence, importance, user_id) of all events."""
    e = read_table(spark, sf_dir, "events")
    retract = F.col("event_type") == "error"
    other = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("seq"), F.when(retract, "retract").otherwise("write").alias("op"), F.concat(F.lit("user_"), "user_id").alias("entity"),
        F.when(retract, other).otherwise(F.col("event_type")).alias("attribute"), F.when(~retract, F.floor(F.col("value") / 10).cast("string")).alias("value"),
        (F.col("event_id") % 100 / 100).alias("confidence"), (F.col("event_id") % 7 / 7).alias("importance"), "user_id",
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as records: every third is structured, each conversation pair of turns one origin."""
    c = read_table(spark, sf_dir, "conversations").where("role <> 'system'")
    named = F.col("turn") % 3 == 1
    return c.select(
        F.concat_ws("-", "conv_id", "turn").alias("record_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.when(named, F.col("role")).otherwise("").alias("entity"),
        F.when(named, "city").otherwise("").alias("attribute"), F.col("text").alias("value"), "text", F.lit("active").alias("status"), F.lit(0).alias("version"),
        F.lit(None).cast("string").alias("supersedes"), F.when(F.col("conv_id") % 5 == 0, "").otherwise(F.concat(F.col("conv_id"), F.lit(":"), F.floor(F.col("turn") / 2))).alias("origin"),
    )


def q_ledger_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action, version and status of every log row."""
    return L.versions(log(spark, sf_dir)).select("seq", "entity", "attribute", "value", "action", "version", "status", "supersedes")


def q_ledger_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The active record of each key."""
    return L.active(L.versions(log(spark, sf_dir))).select("entity", "attribute", "value", "version", "seq")


def q_ledger_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and keys by status."""
    return L.counts(L.versions(log(spark, sf_dir)).where("status is not null"), "status")


def q_ledger_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions with what their duplicates add, counted by key."""
    rows = L.merged_evidence(L.versions(log(spark, sf_dir)))
    return rows.groupBy("entity", "attribute").agg(F.count("*").alias("n_versions"), F.max("n_writes").alias("most_writes"), F.round(F.max("confidence"), 6).alias("confidence"), F.round(F.max("importance"), 6).alias("importance"))


def q_ledger_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes that the admission gate trusts, and those approved later."""
    rows = log(spark, sf_dir).where("op = 'write'").withColumn("trusted", L.admitted(F.col("importance"), F.col("confidence"), F.col("seq") % 50 == 0))
    approvals = rows.where("not trusted and seq % 3 = 0").select("seq", (F.col("seq") + 1000000).alias("approved_seq"))
    return L.approve(rows, approvals).groupBy("trusted").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active records by page."""
    live = L.active(L.versions(log(spark, sf_dir)))
    page = L.page_of(F.concat_ws("::", "entity", "attribute"), 100)
    return live.groupBy(page.alias("page_id")).agg(F.count("*").alias("n_records"), F.round(F.avg("importance"), 6).alias("importance"), F.max("seq").alias("last_access"))


def q_ledger_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' sources as pages, and which stay hot, warm or go cold."""
    own = read_table(spark, sf_dir, "documents").groupBy(F.col("source").alias("page_id")).agg(F.count("*").alias("n_records"), F.max("n_chars").alias("importance"), F.max("doc_id").alias("last_access"))
    return L.tiers(own, hot=3, resident=12)


def q_ledger_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by hash with their load, and which move if only 40 may stay."""
    return L.consolidation_plan(pages(spark, sf_dir), target=40)


def q_ledger_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an audit finds, with edges made to dangle and pages of 20 rows at most."""
    rows = L.versions(log(spark, sf_dir)).where("status is not null")
    edges = rows.where("seq % 100 = 0").select("seq", (F.col("seq") + F.when(F.col("seq") % 200 == 0, 0).otherwise(10**9)).alias("related"))
    held = L.active(rows).groupBy(F.col("entity").alias("page_id")).agg(F.count("*").alias("n_records"))
    return L.audit(rows, edges, held, capacity=3)


def q_ledger_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the first one of the same text."""
    return L.first_by_text(read_table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id", "first_seq")


def q_ledger_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes into 16 slots less one."""
    rows = log(spark, sf_dir).where("op = 'write'").withColumn("slot", F.col("user_id") % 16 - 1)
    return L.by_slot(rows).select("seq", "slot", "status", "superseded_by")


def q_ledger_absorb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose unnamed records a later named one of the turn absorbs."""
    return L.absorb_unidentified(records(spark, sf_dir)).select("record_id", "origin", "status")


def q_ledger_retract_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns forgotten by origin; the blank origin forgets nothing."""
    rows = records(spark, sf_dir)
    gone = rows.where("seq % 7 = 0").select("origin")
    return L.retract_origins(rows, gone).select("record_id", "origin", "status")


def q_ledger_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of some records: old versions superseded, new ones beside them."""
    rows = records(spark, sf_dir)
    none = F.lit(None).cast("string")
    edits = rows.where("seq % 4 = 0").select("record_id", none.alias("entity"), F.lit("town").alias("attribute"), none.alias("value"), none.alias("text"))
    return L.edit(rows, edits).select("record_id", "entity", "attribute", "status", "version", "supersedes")


def q_ledger_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type, as an upsert keeps it."""
    e = read_table(spark, sf_dir, "events")
    return L.latest(e, ("user_id", "event_type"), (F.col("ts").desc(), F.col("event_id").desc())).select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


def q_ledger_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe views of some records, found by id."""
    ids = spark.range(0, 2000, 7).select(F.col("id").alias("doc_id"))
    d = read_table(spark, sf_dir, "documents").join(ids, "doc_id", "left_semi")
    return d.select("doc_id", F.col("source").alias("entity"), F.col("lang").alias("attribute"), F.length("text").alias("n_chars"), T.stable_key(F.col("text")).alias("record_key"))


def q_ledger_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that hold a word, newest first, the second page of twenty."""
    d = read_table(spark, sf_dir, "documents").where(F.lower("text").contains("tion"))
    return d.orderBy(F.col("n_chars").desc(), "doc_id").offset(20).limit(20).select("doc_id", "n_chars")


QUERIES = {
    f.__name__: f
    for f in (
        q_ledger_versions, q_ledger_active, q_ledger_counts, q_ledger_evidence, q_ledger_gate, q_ledger_tiers, q_ledger_pages, q_ledger_audit, q_ledger_texts,
        q_ledger_slots, q_ledger_absorb, q_ledger_retract_origin, q_ledger_edit, q_ledger_latest, q_ledger_lookup, q_ledger_list,
    )
}

_TYPES = ", ".join(f"'{t}'" for t in TYPES)
_LOG = f"""
    log AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'retract' ELSE 'write' END AS op, 'user_' || user_id AS entity,
            CASE WHEN event_type = 'error' THEN [{_TYPES}][(event_id % 4 + 1)::INT] ELSE event_type END AS attribute,
            CASE WHEN event_type <> 'error' THEN floor(value / 10)::BIGINT::VARCHAR END AS value, event_id % 100 / 100.0 AS confidence, event_id % 7 / 7.0 AS importance, user_id FROM events)"""
_VERSIONS = f"""{_LOG},
    e AS (SELECT *, count(*) FILTER (op = 'retract') OVER (PARTITION BY entity, attribute ORDER BY seq) AS ep, max(seq) FILTER (op = 'retract') OVER (PARTITION BY entity, attribute) AS lr FROM log),
    w AS (SELECT *, lag(value) OVER (PARTITION BY entity, attribute, ep ORDER BY seq) AS pv FROM e WHERE op = 'write'),
    n AS (SELECT *, count(*) FILTER (pv IS DISTINCT FROM value) OVER (PARTITION BY entity, attribute, ep ORDER BY seq) - 1 AS version FROM w),
    d AS (SELECT *, lead(seq) OVER (PARTITION BY entity, attribute, ep ORDER BY seq) AS nx, lag(seq) OVER (PARTITION BY entity, attribute, ep ORDER BY seq) AS before FROM n WHERE pv IS DISTINCT FROM value),
    v AS (SELECT seq, entity, attribute, value, CASE WHEN version > 0 THEN 'updated' ELSE 'inserted' END AS action, version::INT AS version,
            CASE WHEN nx IS NOT NULL THEN 'superseded' WHEN lr IS NOT NULL AND seq < lr THEN 'retracted' ELSE 'active' END AS status, before AS supersedes, confidence, importance FROM d
          UNION ALL SELECT seq, entity, attribute, value, 'duplicate', version::INT, NULL, NULL, confidence, importance FROM n WHERE pv IS NOT DISTINCT FROM value
          UNION ALL SELECT seq, entity, attribute, value, 'retract', NULL, NULL, NULL, confidence, importance FROM log WHERE op = 'retract')"""
_RECORDS = """
    r AS (SELECT conv_id || '-' || turn AS record_id, conv_id * 1000 + turn AS seq, CASE WHEN turn % 3 = 1 THEN role ELSE '' END AS entity, CASE WHEN turn % 3 = 1 THEN 'city' ELSE '' END AS attribute,
            CASE WHEN conv_id % 5 = 0 THEN '' ELSE conv_id || ':' || turn // 2 END AS origin FROM conversations WHERE role <> 'system')"""

SQL = {
    "q_ledger_versions": f"WITH {_VERSIONS} SELECT seq, entity, attribute, value, action, version, status, supersedes FROM v",
    "q_ledger_active": f"WITH {_VERSIONS} SELECT entity, attribute, value, version, seq FROM v WHERE status = 'active'",
    "q_ledger_counts": f"WITH {_VERSIONS} SELECT status, count(*) AS n_records, count(DISTINCT (entity, attribute)) AS n_keys FROM v WHERE status IS NOT NULL GROUP BY status",
    "q_ledger_evidence": f"""
        WITH {_VERSIONS}, m AS (SELECT entity, attribute, version, max(confidence) AS c, max(importance) AS i, count(*) AS k FROM v WHERE action <> 'retract' GROUP BY ALL)
        SELECT entity, attribute, count(*) AS n_versions, max(k) AS most_writes, round(max(c), 6)::DOUBLE AS confidence, round(max(i), 6)::DOUBLE AS importance FROM m GROUP BY ALL""",
    "q_ledger_gate": f"""
        WITH {_LOG}, t AS (SELECT seq, seq % 50 = 0 OR NOT (importance < 0.5 OR confidence < 0.25) AS trusted FROM log WHERE op = 'write'),
        a AS (SELECT trusted, CASE WHEN trusted THEN seq ELSE seq + 1000000 END AS seq FROM t WHERE trusted OR seq % 3 = 0)
        SELECT trusted, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM a GROUP BY trusted""",
    "q_ledger_tiers": """
        WITH p AS (SELECT source AS page_id, count(*) AS n_records, max(n_chars) AS importance, max(doc_id) AS last_access FROM documents GROUP BY source),
        k AS (SELECT *, row_number() OVER (ORDER BY importance DESC, last_access DESC, n_records DESC, page_id) AS rk FROM p)
        SELECT page_id, n_records, importance, last_access, CASE WHEN rk <= 3 THEN 'hot' WHEN rk <= 12 THEN 'warm' ELSE 'cold' END AS tier FROM k""",
    "q_ledger_pages": f"""
        WITH {_VERSIONS}, p AS (SELECT (('0x' || substr(sha1(entity || '::' || attribute), 1, 8))::BIGINT % 100)::INT AS page_id, count(*) AS n_records, round(avg(importance::DOUBLE), 6) AS importance, max(seq) AS last_access
                                FROM v WHERE status = 'active' GROUP BY 1)
        SELECT *, row_number() OVER (ORDER BY importance DESC, n_records DESC, page_id) > 40 AND n_records < 32 AS move FROM p""",
    "q_ledger_audit": f"""
        WITH {_VERSIONS}, s AS (SELECT * FROM v WHERE status IS NOT NULL),
        i AS (SELECT 'two_active' AS issue FROM (SELECT 1 FROM s WHERE status = 'active' GROUP BY entity, attribute HAVING count(*) > 1)
          UNION ALL SELECT 'active_superseded' FROM s WHERE status = 'active' AND seq IN (SELECT supersedes FROM s WHERE supersedes IS NOT NULL)
          UNION ALL SELECT 'lost_predecessor' FROM s WHERE supersedes IS NOT NULL AND supersedes NOT IN (SELECT seq FROM s)
          UNION ALL SELECT 'dangling_related' FROM s WHERE seq % 100 = 0 AND seq % 200 <> 0
          UNION ALL SELECT 'over_capacity' FROM (SELECT 1 FROM s WHERE status = 'active' GROUP BY entity HAVING count(*) > 3))
        SELECT issue, count(*) AS n FROM i GROUP BY issue""",
    "q_ledger_texts": "SELECT doc_id, min(doc_id) OVER (PARTITION BY lower(trim(text))) AS first_seq FROM documents",
    "q_ledger_slots": f"""
        WITH {_LOG}, s AS (SELECT seq, user_id % 16 - 1 AS slot FROM log WHERE op = 'write'),
        n AS (SELECT *, lead(seq) OVER (PARTITION BY slot ORDER BY seq) AS superseded_by FROM s WHERE slot >= 0)
        SELECT seq, slot, CASE WHEN superseded_by IS NULL THEN 'active' ELSE 'superseded' END AS status, superseded_by FROM n""",
    "q_ledger_absorb": f"""
        WITH {_RECORDS} SELECT record_id, origin, CASE WHEN origin <> '' AND entity = '' AND seq < max(CASE WHEN entity <> '' THEN seq END) OVER (PARTITION BY origin) THEN 'superseded' ELSE 'active' END AS status FROM r""",
    "q_ledger_retract_origin": f"""
        WITH {_RECORDS} SELECT record_id, origin, CASE WHEN origin <> '' AND origin IN (SELECT origin FROM r WHERE seq % 7 = 0) THEN 'retracted' ELSE 'active' END AS status FROM r""",
    "q_ledger_edit": f"""
        WITH {_RECORDS} SELECT record_id, entity, attribute, CASE WHEN seq % 4 = 0 THEN 'superseded' ELSE 'active' END AS status, 0 AS version, NULL::VARCHAR AS supersedes FROM r
        UNION ALL SELECT record_id || '#1', entity, 'town', 'active', 1, record_id FROM r WHERE seq % 4 = 0""",
    "q_ledger_latest": "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "q_ledger_lookup": "SELECT doc_id, source AS entity, lang AS attribute, length(text)::INT AS n_chars, substr(sha1(text), 1, 20) AS record_key FROM documents WHERE doc_id < 2000 AND doc_id % 7 = 0",
    "q_ledger_list": "SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'tion') ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 20",
}
