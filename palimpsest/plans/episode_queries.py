"""Episodes made of documents, conversations, events and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import datasets as D
from ..operators import episodes as E
from ..operators import ledger as L
from ..operators import metrics as M
from ..sources.files import read_table
from .ledger_queries import _LOG, _VERSIONS, TYPES, log
from .retrieval_queries import _CODE, _DOT, BITS, DIMS
from .text_queries import terms_sql

ALIASES, OPERATIONS = {"en": "english anglais", "fr": "french francais", "de": "german deutsch"}, {3: "third source", 7: "seventh source"}
THRESHOLDS = (0.2, 0.4, 0.6, 0.8)
HARD = ("what time is it", "tell me a joke", "sum up the report")


def q_routing_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' routing texts: source and language as fields, with aliases of both."""
    d = read_table(spark, sf_dir, "documents")
    attribute = F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(F.concat(F.lit("operational:x: "), F.col("doc_id") % 10))
    said = T.routing_text(F.substring("text", 1, 40), F.col("source"), attribute, F.lit(" "), ALIASES, OPERATIONS)
    return d.select("doc_id", said.alias("routing_text"))


def q_token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in runs of 512 words, each naming the one before."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", T.bm25_words(F.col("text")).alias("words"))
    return E.token_chunks(d, "doc_id").select("doc_id", "chunk", "n_words", "previous", F.length("text").alias("n_chars"), F.substring("text", 1, 30).alias("begins"))


def q_structural_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as episodes: the first turn asks, others are candidates; some are made wrong on purpose."""
    c = read_table(spark, sf_dir, "conversations")
    words = T.bm25_words(F.col("text"))
    q = c.where("turn = 0").select("conv_id", F.filter(words, lambda w: F.length(w) > 4).alias("asked"))
    own = c.where("turn > 0").select("conv_id", F.struct("turn", "role", F.lower("text").alias("low"), F.filter(words, lambda w: F.length(w) > 4).alias("words")).alias("s"))
    e = q.join(own.groupBy("conv_id").agg(F.sort_array(F.collect_list("s")).alias("cand")), "conv_id")
    n = F.size("cand")
    wanted = F.when(F.col("conv_id") % 4 == 0, F.array().cast("array<int>")).otherwise(F.array((F.col("conv_id") % n).cast("int")))
    e = e.withColumn("positives", wanted)
    target = F.get("cand", F.get("positives", F.lit(0)))
    e = e.withColumn("words", target["words"]).withColumn("answer", F.get(target["words"], F.lit(0)))
    holders = F.filter(F.transform("cand", lambda x, i: F.when(F.contains(x["low"], F.col("answer")), i)), lambda i: i.isNotNull())
    known = F.size("positives") > 0
    issues = E.structural_issues(
        F.when(known & (F.col("conv_id") % 7 != 0), 1.0).otherwise(0.0), F.when(known, 1).otherwise(F.when(F.col("conv_id") % 8 == 0, 1).otherwise(0)), known | (F.col("conv_id") % 12 == 0),
        F.col("positives"), F.coalesce(F.get("positives", F.lit(0)), F.lit(0)) + F.when(F.col("conv_id") % 9 == 0, 1).otherwise(0),
        F.coalesce(F.arrays_overlap("asked", "words"), F.lit(False)), holders, F.transform("cand", lambda x: F.concat(x["role"], F.floor(x["turn"] / 2).cast("string"))),
    )
    return e.select("conv_id", F.size("cand").alias("n_candidates"), F.array_join(issues, ",").alias("issues"))


def q_answer_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation in their write order: five facts at most, each fourth turn an answer."""
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") % 4 == 1).alias("positive"))
    return E.answer_last(c, "conv_id", "turn", "positive", 5)


def q_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The beginnings of each conversation's best two turns."""
    c = read_table(spark, sf_dir, "conversations")
    c = c.select("conv_id", "turn", ((F.col("turn") * 37 + F.col("conv_id") * 11) % 100 / 100).alias("score"), F.substring("text", 1, 20).alias("said"))
    return E.prefixes(c, "conv_id", "score", "turn", "said")


def q_sweep_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether one made-up quality score is no worse than another at every threshold, by axis."""
    rows, values = read_table(spark, sf_dir, "labels"), None
    for system, score in (("a", F.col("quality") * 0.3 + F.col("doc_id") * 7 % 100 / 142), ("b", F.col("quality") * 0.1 + F.col("doc_id") * 13 % 100 / 111)):
        swept = M.sweep(rows.select(F.round(score, 6).alias("score"), "quality"), "score", "quality", THRESHOLDS)
        axes = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.lit(d).alias("direction"), F.col(a).alias("value")) for a, d in (("f1", "max"), ("unknown_refusal", "max"), ("known_false_refusal", "min")))))
        part = swept.select("threshold", axes.alias("x")).select("threshold", "x.*", F.lit(system).alias("system"))
        values = part if values is None else values.union(part)
    return E.sweep_dominance(values, "a", "b")


def q_write_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes of the event log that are still active, and whether each user's last purchase is."""
    v = L.versions(log(spark, sf_dir)).where("status is not null")
    v = v.select("entity", F.length("entity").cast("long").alias("category"), F.concat_ws("=", "attribute", "value").alias("value"), (F.col("status") == "active").alias("active"))
    w = log(spark, sf_dir).where("op = 'write' and attribute = 'purchase'")
    last = w.groupBy("entity").agg(F.max_by(F.concat_ws("=", "attribute", "value"), "seq").alias("value"))
    return E.write_survival(v, last.select("entity", F.length("entity").cast("long").alias("category"), "value"), "entity", "category")


def q_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as replies of two runs: the whole turn, and its first half."""
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lower("text").alias("t"), (F.col("turn") % 3 != 0).alias("answerable"))
    c = c.withColumn("key", F.col("conv_id") * 1000 + F.col("turn"))
    acceptable, forbidden = F.array(F.lit("the "), F.lit("tion")), F.array(F.lit("idiot"), F.concat(F.lit("x"), F.col("turn")))
    run = lambda reply: c.select("key", "role", E.passes(reply, acceptable, forbidden, F.col("answerable"), F.length(reply) < 80).alias("passed"))
    return E.parity(run(F.col("t")), run(F.expr("substring(t, 1, cast(floor(length(t) / 2) as int))")), "key", "role")


def q_replaced_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as pages: the codes of even vectors, with labels 1 and 3 taking those of all vectors anew."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("page_id"), V.signature(F.col("embedding"), BITS, DIMS).alias("code"))
    return E.replace_buckets(e.where("vec_id % 2 = 0").select("page_id", "code").distinct(), e.where("page_id in (1, 3)").select("page_id", "code"))


def q_mined_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as facts of their type, asked by benchmark items: a right and a wrong query of each."""
    types = F.array(*map(F.lit, TYPES))
    asked = read_table(spark, sf_dir, "benchmark").select(F.element_at(types, (F.col("item_id") % len(TYPES) + 1).cast("int")).alias("attribute"), F.substring("text", 1, 30).alias("query"))
    return D.mined_pairs(read_table(spark, sf_dir, "events").select(F.col("event_id").alias("fact_id"), F.col("event_type").alias("attribute")), asked, HARD)


def q_update_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes of the event log with the next write of their entity."""
    return D.update_pairs(log(spark, sf_dir).where("op = 'write'"))


def q_close_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors in blocks of twenty neighbours, with the terms of the documents of the same number."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 20).alias("block"), F.col("embedding").alias("vector"))
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), T.terms(F.col("text")).alias("tokens"))
    return D.close_pairs(e.join(d, "vec_id"), "vec_id", "block", most_similar=0.2, least_shared=20)


QUERIES = {
    f.__name__: f
    for f in (q_mined_pairs, q_update_pairs, q_close_pairs, q_routing_text, q_token_chunks, q_structural_issues, q_answer_last, q_prefixes, q_sweep_dominance, q_write_survival, q_parity, q_replaced_buckets)
}

_WORDS = "regexp_extract_all(lower(text), '[a-z0-9'']+')"
_HAS = "CASE WHEN {c} THEN '{n},' ELSE '' END"


def _issues(checks: dict[str, str]) -> str:
    return "rtrim(" + " || ".join(_HAS.format(c=f"coalesce({c}, false)", n=n) for n, c in checks.items()) + ", ',')"


def _sweep_sql(system: str, score: str) -> str:
    return f"""SELECT '{system}' AS system, threshold, count(*) FILTER (s >= threshold AND q) AS tp, count(*) FILTER (s >= threshold AND NOT q) AS fp, count(*) FILTER (s < threshold AND q) AS fn,
               count(*) FILTER (s < threshold AND NOT q) AS tn FROM (SELECT round({score}, 6) AS s, quality = 1 AS q FROM labels), t GROUP BY threshold"""


SQL = {
    "q_routing_text": f"""
        WITH d AS (SELECT doc_id, substr(text, 1, 40) AS t, source, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'operational:x: ' || doc_id % 10 END AS a FROM documents)
        SELECT doc_id, array_to_string(list_filter([t, source, a, CASE a {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ALIASES.items())} ELSE '' END,
            CASE {" ".join(f"WHEN a = 'operational:x: {k}' THEN '{v}'" for k, v in OPERATIONS.items())} ELSE '' END], lambda p: trim(p) <> ''), ' ') AS routing_text FROM d""",
    "q_token_chunks": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, ceil(len(w) / 512.0)::BIGINT)) AS i FROM d),
        k AS (SELECT doc_id, i, w[i * 512 + 1:i * 512 + 512] AS w FROM c)
        SELECT doc_id, i::INT AS chunk, len(w)::INT AS n_words, CASE WHEN i > 0 THEN i::INT - 1 END AS previous, length(array_to_string(w, ' '))::INT AS n_chars, substr(array_to_string(w, ' '), 1, 30) AS begins FROM k""",
    "q_structural_issues": f"""
        WITH q AS (SELECT conv_id, list_filter({_WORDS}, lambda w: length(w) > 4) AS asked FROM conversations WHERE turn = 0),
        c AS (SELECT conv_id, lower(text) AS low, list_filter({_WORDS}, lambda w: length(w) > 4) AS words, role || (turn // 2) AS attribute, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE turn > 0),
        g AS (SELECT conv_id, any_value(n) AS n, count(DISTINCT attribute) AS n_attributes FROM c GROUP BY conv_id),
        e AS (SELECT q.conv_id, asked, n, n_attributes, CASE WHEN q.conv_id % 4 <> 0 THEN q.conv_id % n END AS p FROM q JOIN g USING (conv_id)),
        t AS (SELECT e.*, c.words, c.words[1] AS answer FROM e LEFT JOIN c ON c.conv_id = e.conv_id AND c.i = e.p),
        h AS (SELECT t.conv_id, list(c.i ORDER BY c.i) FILTER (contains(c.low, t.answer)) AS holders FROM t JOIN c USING (conv_id) GROUP BY t.conv_id)
        SELECT conv_id, n::INT AS n_candidates, {_issues({
            "unknown_with_need_or_hop": "p IS NULL AND conv_id % 8 = 0", "unknown_answerable": "p IS NULL AND conv_id % 12 = 0", "index_disagrees": "p IS NOT NULL AND conv_id % 9 = 0",
            "known_without_need_or_hop": "p IS NOT NULL AND conv_id % 7 = 0", "overlaps_target": "p IS NOT NULL AND list_has_any(asked, words)",
            "answer_elsewhere": "p IS NOT NULL AND coalesce(holders, []) <> [p]", "repeated_attribute": "p IS NOT NULL AND n_attributes < n",
        })} AS issues FROM t JOIN h USING (conv_id)""",
    "q_answer_last": """
        WITH c AS (SELECT conv_id, turn, turn % 4 = 1 AS positive, greatest(0, 5 - count(*) FILTER (turn % 4 = 1) OVER (PARTITION BY conv_id)) AS room, row_number() OVER (PARTITION BY conv_id, turn % 4 = 1 ORDER BY turn) AS nth FROM conversations)
        SELECT conv_id, turn, positive, row_number() OVER (PARTITION BY conv_id ORDER BY positive, turn)::INT AS place FROM c WHERE positive OR nth <= room""",
    "q_prefixes": """
        WITH c AS (SELECT conv_id, turn, (turn * 37 + conv_id * 11) % 100 / 100.0 AS score, substr(text, 1, 20) AS said FROM conversations),
        k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS rk FROM c WHERE score >= 0.40 QUALIFY rk <= 2)
        SELECT conv_id, count(*) AS n_slots, string_agg(said, ' ' ORDER BY rk) AS prefix FROM k GROUP BY conv_id""",
    "q_sweep_dominance": f"""
        WITH t AS (SELECT unnest({list(THRESHOLDS)}::DOUBLE[]) AS threshold), s AS ({_sweep_sql("a", "quality * 0.3::DOUBLE + doc_id * 7 % 100 / 142::DOUBLE")} UNION ALL {_sweep_sql("b", "quality * 0.1::DOUBLE + doc_id * 13 % 100 / 111::DOUBLE")}),
        m AS (SELECT system, threshold, tp / nullif(tp + fp, 0)::DOUBLE AS p, tp / nullif(tp + fn, 0)::DOUBLE AS r, tn / nullif(tn + fp, 0)::DOUBLE AS u, fn / nullif(fn + tp, 0)::DOUBLE AS k FROM s),
        x AS (SELECT system, threshold, 'f1' AS axis, 'max' AS direction, round(CASE WHEN p > 0 AND r > 0 THEN 2 * p * r / (p + r) END, 6) AS value FROM m UNION ALL SELECT system, threshold, 'unknown_refusal', 'max', round(u, 6) FROM m
              UNION ALL SELECT system, threshold, 'known_false_refusal', 'min', round(k, 6) FROM m)
        SELECT a.axis, a.direction, count(*) AS n_thresholds, bool_and(CASE WHEN a.direction = 'max' THEN a.value - b.value ELSE b.value - a.value END >= -1e-12) AS holds
        FROM x a JOIN x b ON a.threshold = b.threshold AND a.axis = b.axis AND a.system = 'a' AND b.system = 'b' WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY ALL""",
    "q_write_survival": f"""
        WITH {_VERSIONS}, wr AS (SELECT entity, length(entity)::BIGINT AS category, attribute || '=' || value AS value, status = 'active' AS active FROM v WHERE status IS NOT NULL),
        lp AS (SELECT entity, length(entity)::BIGINT AS category, max_by('purchase=' || value, seq) AS value FROM log WHERE op = 'write' AND attribute = 'purchase' GROUP BY ALL),
        al AS (SELECT DISTINCT entity, value FROM wr WHERE active),
        nt AS (SELECT category, count(*) AS n_targets, count(al.entity) AS n_survived FROM lp LEFT JOIN al ON lp.entity = al.entity AND lp.value = al.value GROUP BY category)
        SELECT category, count(*) AS n_written, count(*) FILTER (active) AS n_active, coalesce(any_value(n_targets), 0) AS n_targets, coalesce(any_value(n_survived), 0) AS n_survived FROM wr LEFT JOIN nt USING (category) GROUP BY category""",
    "q_parity": """
        WITH c AS (SELECT role, turn, turn % 3 <> 0 AS answerable, lower(text) AS t FROM conversations), r AS (SELECT *, substr(t, 1, length(t) // 2) AS h FROM c),
        p AS (SELECT role, NOT (contains(t, 'idiot') OR contains(t, 'x' || turn)) AND (contains(t, 'the ') OR contains(t, 'tion') OR (NOT answerable AND length(t) < 80)) AS a,
              NOT (contains(h, 'idiot') OR contains(h, 'x' || turn)) AND (contains(h, 'the ') OR contains(h, 'tion') OR (NOT answerable AND length(h) < 80)) AS b FROM r)
        SELECT role, count(*) AS n, count(*) FILTER (a) AS teacher, count(*) FILTER (b) AS student, count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS lost, count(*) FILTER (b AND NOT a) AS gained FROM p GROUP BY role""",
    "q_replaced_buckets": f"""
        WITH e AS (SELECT vec_id, label AS page_id, ({_CODE})::BIGINT AS code FROM (SELECT vec_id, label, embedding AS v FROM embeddings))
        SELECT DISTINCT page_id, code FROM e WHERE vec_id % 2 = 0 AND page_id NOT IN (1, 3) UNION SELECT DISTINCT page_id, code FROM e WHERE page_id IN (1, 3)""",
    "q_mined_pairs": f"""
        WITH p AS (SELECT ({list(TYPES)})[item_id % {len(TYPES)} + 1] AS attribute, list_sort(list(DISTINCT substr(text, 1, 30))) AS pool FROM benchmark GROUP BY 1),
        k AS (SELECT *, row_number() OVER (ORDER BY attribute) - 1 AS nth, count(*) OVER () AS n FROM p),
        f AS (SELECT event_id AS fact_id, nth, n, k.attribute, pool, {", ".join(f"('0x' || substr(sha1('0|{w}|' || event_id), 1, 8))::BIGINT AS h_{w}" for w in ("own", "attribute", "hard", "other"))} FROM events JOIN k ON k.attribute = event_type),
        o AS (SELECT fact_id, h_hard, h_other, (nth + 1 + h_attribute % (n - 1)) % n AS nth FROM f WHERE n > 1),
        x AS (SELECT fact_id, k.attribute, pool, h_other % (len(pool) + CASE WHEN h_hard % 2 = 0 THEN {len(HARD)} ELSE 0 END) AS i FROM o JOIN k USING (nth))
        SELECT fact_id, 1 AS label, pool[h_own % len(pool) + 1] AS query, attribute AS asked FROM f
        UNION ALL SELECT fact_id, 0, CASE WHEN i >= len(pool) THEN ({list(HARD)})[i - len(pool) + 1] ELSE pool[i + 1] END, CASE WHEN i < len(pool) THEN attribute END FROM x""",
    "q_update_pairs": f"""
        WITH {_LOG}, w AS (SELECT seq, attribute, lead(seq) OVER (PARTITION BY entity, attribute ORDER BY seq) AS same, lead(seq) OVER (PARTITION BY entity ORDER BY seq) AS nx, lead(attribute) OVER (PARTITION BY entity ORDER BY seq) AS na FROM log WHERE op = 'write')
        SELECT seq, same AS next_seq, 1 AS label FROM w WHERE same IS NOT NULL UNION ALL SELECT seq, nx, 0 FROM w WHERE na <> attribute""",
    "q_close_pairs": f"""
        WITH e AS (SELECT vec_id, vec_id // 20 AS block, embedding AS v, {terms_sql("text")} AS t FROM embeddings JOIN documents ON doc_id = vec_id),
        p AS (SELECT a.vec_id AS left_key, b.vec_id AS right_key, round({_DOT.format("a.v", "b.v")} / (sqrt({_DOT.format("a.v", "a.v")}) * sqrt({_DOT.format("b.v", "b.v")})), 6) AS score, len(list_intersect(a.t, b.t))::INT AS shared
              FROM e a JOIN e b ON a.block = b.block AND a.vec_id < b.vec_id)
        SELECT *, score >= 0.2 AS confirmed, score >= 0.2 AND shared >= 20 AS guarded FROM p""",
}
