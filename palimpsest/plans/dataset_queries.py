"""Building datasets from conversations, documents and the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import datasets as D
from ..sources.files import manifest, read_table
from .text_queries import terms_sql


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, group_id, attribute): documents, in groups of their source, by language."""
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("source").alias("group_id"), F.col("lang").alias("attribute"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "conversations").withColumn("turn_id", F.col("conv_id") * 1000 + F.col("turn"))


def q_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with kind, label and origin."""
    out = D.normalised_turns(read_table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "turn", F.sha1(F.encode("text", "UTF-8")).alias("digest"), "kind", "write_label", "origin", "question")


def q_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every document's source, by hash; one source is set by hand."""
    d = read_table(spark, sf_dir, "documents").select("source").distinct()
    explicit = F.when(F.col("source") == "src3", "eval")
    return d.select("source", D.split_of(F.col("source"), 0.3, explicit).alias("split"), F.round(T.hash_share(F.col("source")), 6).alias("share"))


def q_first_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text and language."""
    return D.first_of(read_table(spark, sf_dir, "documents"), ["text", "lang"], ["doc_id"]).select("doc_id", "source")


def q_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first seven documents of each source."""
    return D.capped(read_table(spark, sf_dir, "documents"), "source", "doc_id", 7).select("doc_id", "source")


def q_tail_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five documents of each source are eval."""
    return D.tail_split(read_table(spark, sf_dir, "documents"), "source", "doc_id", 5).select("doc_id", "source", "split")


def q_even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven documents of each language at even distances."""
    return D.even_sample(read_table(spark, sf_dir, "documents"), "lang", "doc_id", 11).select("doc_id", "lang")


def _episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).withColumn("episode_id", F.col("item_id") * 10)


def q_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight negatives of every document, from three pools."""
    return D.hard_negatives(_episodes(spark, sf_dir), _items(spark, sf_dir), 8)


def q_negative_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the negatives of every document, as in the SQL: their number, distinctness, and no conflict with the positive."""
    e = _episodes(spark, sf_dir)
    n = D.hard_negatives(e, _items(spark, sf_dir), 8).join(_items(spark, sf_dir).toDF("item_id", "n_group", "n_attribute"), "item_id")
    j = n.join(e.select("episode_id", "group_id", "attribute"), "episode_id")
    bad = (F.col("n_group") == F.col("group_id")) & (F.col("n_attribute") == F.col("attribute"))
    return j.agg(F.count_distinct("episode_id").alias("n_episodes"), F.count("*").alias("n_negatives"), F.count_distinct("episode_id", "item_id").alias("n_distinct"), F.count_if(bad).alias("n_conflicts"))


def q_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source its twelve first candidates: long documents are positives, repeated texts go."""
    d = read_table(spark, sf_dir, "documents").select(F.col("source").alias("episode_id"), "text", F.col("doc_id").alias("pos"), (F.col("n_chars") > 5000).alias("positive"))
    return D.compacted(d, 12).select("episode_id", "pos", "positive", "place")


def q_bounded_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each conversation's first turn a pool of at most six: evidence, the same conversation, others."""
    t = _turns(spark, sf_dir)
    q = t.where("turn = 0").select(F.col("conv_id").alias("query_id"))
    own = q.join(t, F.col("query_id") == F.col("conv_id")).select("query_id", "turn_id", "text", F.when(F.col("turn") == 1, 0).otherwise(1).alias("priority"))
    near = q.join(t, F.col("conv_id") == F.col("query_id") + 1).select("query_id", "turn_id", "text", F.lit(2).alias("priority"))
    return D.bounded_pool(own.unionByName(near), 6, 4).select("query_id", "turn_id", "priority", "place")


def q_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, sources and languages that two halves of the documents share."""
    d = read_table(spark, sf_dir, "documents")
    return D.leakage(d.where("doc_id % 4 <> 0"), d.where("doc_id % 4 = 0"), ["text", "source", "lang", "doc_id"])


def q_text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts of documents and turns, with the first place of each."""
    d = read_table(spark, sf_dir, "documents").select("text", F.col("doc_id").alias("pos"))
    c = _turns(spark, sf_dir).select("text", (F.col("turn_id") + 10**9).alias("pos"))
    return D.text_rows(d.unionByName(c))


def q_merged_banks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two banks of texts, the first one's keys winning."""
    rows = D.text_rows(read_table(spark, sf_dir, "documents").select("text", F.col("doc_id").alias("pos")))
    first, second = rows.where("first_pos % 3 <> 0"), rows.where("first_pos % 2 = 0").withColumn("first_pos", -F.col("first_pos"))
    return D.merged_banks(first, second)


def q_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of equal length within a budget: none over it, none mixed."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.floor(F.size(T.terms(F.col("text"))) / 20).alias("n_tokens"))
    return D.length_batches(d, 100, order="doc_id", parts=4).groupBy("n_tokens", "part", "batch").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("used"))


def q_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive events of one type."""
    e = read_table(spark, sf_dir, "events").select("event_type", "event_id")
    return D.runs(e, "event_type", "event_id").select("event_type", "first", "last", "n")


def q_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as episodes, by the number of their turns."""
    c = read_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_candidates"), F.count_if(F.col("role") == "assistant").alias("n_positive"))
    return D.profile(c.withColumn("size", F.col("n_candidates") % 3), "size")


def q_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each conversation the last durable turn of the asked role, or else its last one."""
    t = _turns(spark, sf_dir).select(
        F.col("conv_id").alias("group_id"), F.col("turn").alias("seq"), F.col("role").alias("attribute"), F.when(F.col("turn") % 5 == 4, "noise").otherwise("fact").alias("kind"),
        F.when(F.col("turn") % 3 == 2, 0.0).otherwise(1.0).alias("write_label"),
    )
    q = t.select("group_id").distinct().select("group_id", F.concat(F.lit("who says "), "group_id").alias("query"), F.lit("system").alias("attribute"))
    return D.episodes(t, q)


def q_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each user's newest value of a type is the one expected."""
    f = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.col("event_type").alias("attribute"), F.col("event_id").alias("seq"), F.floor(F.col("value") / 50).cast("string").alias("value"))
    x = f.select("case_id").distinct().select("case_id", F.when(F.col("case_id") % 10 == 0, "none").otherwise("click").alias("attribute"), F.lit("0").alias("expected"))
    return D.update_conflicts(f, x).groupBy("posed").agg(F.count("*").alias("n"), F.sum("n_facts").alias("n_facts"), F.max("n_values").alias("most_values"))


def q_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation padded to eight."""
    c = _turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list("turn_id")).alias("candidate_ids"))
    out = D.padded(c, 8)
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return out.select("conv_id", join(F.col("padded")).alias("padded"), join(F.col("mask")).alias("mask"))


def q_answerability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as episodes, with and without their positives."""
    c = _turns(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn_id", "role"))).alias("candidates"))
    at = F.transform("candidates", lambda x, i: F.when(x["role"] == "assistant", i).otherwise(-1))
    out = D.answerability(c.withColumn("positive_indices", F.filter(at, lambda i: i >= 0)))
    return out.select("conv_id", "variant", F.size("candidates").alias("n_candidates"), F.size("positive_indices").alias("n_positive"))


def q_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and digests of three tables; the digest is Spark's."""
    return manifest({n: read_table(spark, sf_dir, n) for n in ("documents", "benchmark", "labels")}, "group split").select("part", "n_rows", "policy")


def q_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About a hundred documents, the same share of each language; chosen by hash."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    return D.balanced(d, "lang", "doc_id", 100).select("doc_id", "lang")


QUERIES = {
    f.__name__: f
    for f in (
        q_turns, q_split, q_first_texts, q_capped, q_tail_split, q_even_sample, q_hard_negatives, q_negative_checks, q_compacted, q_bounded_pool, q_leakage, q_text_rows,
        q_merged_banks, q_batches, q_runs, q_profile, q_episodes, q_conflicts, q_padded, q_answerability, q_manifest, q_balanced,
    )
}

_TEXT_ROWS = "SELECT sha1(text) AS text_sha1, min(pos) AS first_pos, count(*) AS n FROM ({}) WHERE text IS NOT NULL GROUP BY 1"
_DOCS = "SELECT text, doc_id AS pos FROM documents"

SQL = {
    "q_batches": f"""
        WITH d AS (SELECT len({terms_sql("text")}) // 20 AS n_tokens, ('0x' || substr(sha1(doc_id::VARCHAR), 1, 8))::BIGINT % 4 AS part, doc_id FROM documents),
        b AS (SELECT n_tokens, part, (row_number() OVER (PARTITION BY n_tokens, part ORDER BY doc_id) - 1) // greatest(1, 100 // greatest(1, n_tokens)) AS batch FROM d)
        SELECT n_tokens, part, batch, count(*) AS n, sum(n_tokens)::BIGINT AS used FROM b GROUP BY ALL""",
    "q_turns": r"""
        SELECT conv_id, turn, sha1(b) AS digest, CASE WHEN role <> 'user' THEN 'reply' WHEN b = '' THEN 'empty' WHEN contains(b, '?') THEN 'query' ELSE 'episode' END AS kind,
               CASE WHEN role = 'user' AND b <> '' AND NOT contains(b, '?') THEN 1.0 ELSE 0.0 END AS write_label, CASE WHEN role <> 'user' OR trim(text) = '' THEN '' ELSE substr(sha1(trim(text)), 1, 16) END AS origin,
               contains(b, '?') AS question FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS b FROM conversations)""",
    "q_split": """
        WITH d AS (SELECT DISTINCT source, ('0x' || substr(sha1(source), 1, 8))::BIGINT::DOUBLE / 4294967295 AS x FROM documents)
        SELECT source, CASE WHEN source = 'src3' OR x < 0.3 THEN 'eval' ELSE 'train' END AS split, round(x, 6) AS share FROM d""",
    "q_first_texts": "SELECT min(doc_id) AS doc_id, min_by(source, doc_id) AS source FROM documents GROUP BY text, lang",
    "q_capped": "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 7",
    "q_tail_split": "SELECT doc_id, source, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) <= 5 THEN 'eval' ELSE 'train' END AS split FROM documents",
    "q_even_sample": """
        WITH d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM documents)
        SELECT doc_id, lang FROM d WHERE n <= 11 OR p IN (SELECT i * n // 11 FROM range(11) r(i))""",
    "q_negative_checks": "SELECT count(*) AS n_episodes, count(*) * 8 AS n_negatives, count(*) * 8 AS n_distinct, 0::BIGINT AS n_conflicts FROM documents",
    "q_compacted": """
        WITH o AS (SELECT source AS episode_id, doc_id AS pos, n_chars > 5000 AS positive FROM documents QUALIFY row_number() OVER (PARTITION BY source, text ORDER BY (n_chars <= 5000), doc_id) = 1)
        SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY NOT positive, pos)::INT AS place FROM o QUALIFY place <= 12""",
    "q_bounded_pool": """
        WITH t AS (SELECT *, conv_id * 1000 + turn AS turn_id FROM conversations), q AS (SELECT conv_id AS query_id FROM t WHERE turn = 0),
        c AS (SELECT query_id, turn_id, text, CASE WHEN turn = 1 THEN 0 ELSE 1 END AS priority FROM q JOIN t ON conv_id = query_id UNION ALL SELECT query_id, turn_id, text, 2 FROM q JOIN t ON conv_id = query_id + 1),
        o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query_id, text ORDER BY priority, turn_id) = 1),
        p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY priority, sha1(query_id || '|' || text), turn_id)::INT AS place, count(*) OVER (PARTITION BY query_id) AS n FROM o)
        SELECT query_id, turn_id, priority, place FROM p WHERE place <= 6 AND n >= 4""",
    "q_leakage": " UNION ALL ".join(
        f"SELECT '{c}' AS what, count(*) AS n_eval, count(*) FILTER (x IN (SELECT {c}::VARCHAR FROM documents WHERE doc_id % 4 <> 0)) AS n_shared, "
        f"round(count(*) FILTER (x IN (SELECT {c}::VARCHAR FROM documents WHERE doc_id % 4 <> 0)) / nullif(count(*), 0), 6) AS rate FROM (SELECT DISTINCT {c}::VARCHAR AS x FROM documents WHERE doc_id % 4 = 0)"
        for c in ("text", "source", "lang", "doc_id")
    ),
    "q_text_rows": _TEXT_ROWS.format(f"{_DOCS} UNION ALL SELECT text, conv_id * 1000 + turn + 1000000000 FROM conversations"),
    "q_merged_banks": f"""
        WITH r AS ({_TEXT_ROWS.format(_DOCS)}) SELECT * FROM r WHERE first_pos % 3 <> 0
        UNION ALL SELECT text_sha1, -first_pos, n FROM r WHERE first_pos % 2 = 0 AND first_pos % 3 = 0""",
    "q_runs": """
        WITH e AS (SELECT event_type, event_id, event_id - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events)
        SELECT event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM e GROUP BY event_type, i""",
    "q_profile": """
        WITH c AS (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'assistant') AS p FROM conversations GROUP BY conv_id)
        SELECT n % 3 AS size, count(*) AS n_episodes, count(*) FILTER (p > 0) AS n_answerable, count(*) FILTER (p = 0) AS n_unknown, min(n) AS min_candidates, max(n) AS max_candidates, round(avg(p), 6) AS mean_positives FROM c GROUP BY 1""",
    "q_episodes": """
        WITH o AS (SELECT conv_id, turn, role FROM conversations WHERE turn % 5 <> 4 AND turn % 3 <> 2)
        SELECT c.conv_id AS group_id, 'who says ' || c.conv_id AS query, 'system' AS attribute, coalesce(max(turn) FILTER (role = 'system'), max(turn)) AS positive_seq
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN o USING (conv_id) GROUP BY ALL""",
    "q_conflicts": """
        WITH f AS (SELECT user_id, event_type, count(*) AS n, count(DISTINCT floor(value / 50)) AS v, max_by(floor(value / 50)::BIGINT, event_id) AS newest FROM events GROUP BY ALL),
        x AS (SELECT DISTINCT user_id, CASE WHEN user_id % 10 = 0 THEN 'none' ELSE 'click' END AS event_type FROM events)
        SELECT CASE WHEN n IS NULL THEN 'no_fact' WHEN newest = 0 THEN 'well_posed' ELSE 'ill_posed' END AS posed, count(*) AS n, sum(n)::BIGINT AS n_facts, max(v) AS most_values FROM x LEFT JOIN f USING (user_id, event_type) GROUP BY 1""",
    "q_padded": """
        WITH c AS (SELECT conv_id, list_sort(list(conv_id * 1000 + turn))[1:8] AS ids FROM conversations GROUP BY conv_id)
        SELECT conv_id, array_to_string(list_concat(ids, list_transform(range(8 - len(ids)), lambda i: -1)), ',') AS padded,
               array_to_string(list_concat(list_transform(ids, lambda i: 1), list_transform(range(8 - len(ids)), lambda i: 0)), ',') AS mask FROM c""",
    "q_answerability": """
        WITH c AS (SELECT conv_id, count(*)::INT AS n, count(*) FILTER (role = 'assistant')::INT AS p FROM conversations GROUP BY conv_id)
        SELECT conv_id, CASE WHEN p > 0 THEN 'answerable' ELSE 'unknown' END AS variant, n AS n_candidates, p AS n_positive FROM c UNION ALL SELECT conv_id, 'answer_removed', n - p, 0 FROM c WHERE p > 0""",
    "q_manifest": " UNION ALL ".join(f"SELECT '{n}' AS part, count(*) AS n_rows, 'group split' AS policy FROM {n}" for n in ("benchmark", "documents", "labels")),
    "q_balanced": """
        WITH s AS (SELECT lang, count(*) AS size FROM documents GROUP BY lang)
        SELECT doc_id, lang FROM documents JOIN s USING (lang) WHERE ('0x' || substr(sha1(doc_id::VARCHAR), 1, 8))::BIGINT::DOUBLE / 4294967295 < 100 * 1.0::DOUBLE / (SELECT count(*) FROM s) / size""",
}
