"""Group leakage, inherited keys, template slots, JSON lines and snapshots, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import datasets as D
from ..operators import ledger as L
from ..operators import learned as N
from ..sources import files
from .ledger_queries import _VERSIONS, log

TEMPLATES = ("my {a} is {b}.", "the role of turn {a} (now) is {b}")


def q_shared_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that both splits have if turns, not conversations, are split."""
    turns = files.read_table(spark, sf_dir, "conversations").select("conv_id", D.split_of(F.concat_ws("-", "conv_id", "turn")).alias("split"))
    return D.shared_keys(turns.where("split = 'train'"), turns.where("split = 'eval'"), "conv_id")


def q_inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns whose blank attribute comes from the best of the replies up to three turns before."""
    c = files.read_table(spark, sf_dir, "conversations")
    turns = c.where("role = 'user'").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.when(F.col("turn") % 4 == 0, "own").otherwise("").alias("attribute"))
    replies = c.where("role = 'assistant'").select("conv_id", "turn", F.concat("role", F.lit(":"), "turn").alias("attribute"), (F.length("text") % 11).cast("double").alias("score"))
    near = turns.select("conv_id", "query_id", F.explode(F.array(*(F.col("turn") - i for i in (1, 2, 3)))).alias("turn"))
    return N.inherited_keys(turns.select("query_id", "attribute"), near.join(replies, ["conv_id", "turn"]).select("query_id", "attribute", "score"))


def q_template_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value that a sentence about each turn holds, by the template that it follows."""
    said = (
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("my "), "role", F.lit(" is "), "turn", F.lit(".")))
        .when(F.col("turn") % 3 == 1, F.concat(F.lit("the role of turn "), "turn", F.lit(" (now) is "), "role")).otherwise(F.concat(F.lit("nothing at "), "turn"))
    )
    return files.read_table(spark, sf_dir, "conversations").select("conv_id", "turn", T.slot_value(said, TEMPLATES).alias("value"))


def q_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns, written as JSON lines and read back."""
    c = files.read_table(spark, sf_dir, "conversations")
    path = files.scratch(spark, "turns")
    files.write_jsonl(c, path)
    return files.read_jsonl(spark, path, c.schema).select("conv_id", "turn", "role", F.sha1(F.encode("text", "UTF-8")).alias("digest"))


def q_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger's versions by status, written as a snapshot and read back with a column that it lacks."""
    path = files.scratch(spark, "ledger")
    files.write_snapshot(L.versions(log(spark, sf_dir)).where("status is not null").select("seq", "version", "status"), path, "status")
    return files.read_snapshot(spark, path, {"tier": "warm"}).groupBy("status", "version", "tier").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq"))


QUERIES = {f.__name__: f for f in (q_shared_groups, q_inherited, q_template_values, q_jsonl, q_snapshot)}

SQL = {
    "q_shared_groups": """
        WITH t AS (SELECT conv_id, ('0x' || substr(sha1(conv_id || '-' || turn), 1, 8))::BIGINT / 4294967295.0 < 0.2 AS held FROM conversations)
        SELECT conv_id FROM t GROUP BY conv_id HAVING bool_or(held) AND bool_or(NOT held)""",
    "q_inherited": """
        WITH t AS (SELECT conv_id, turn, conv_id * 1000 + turn AS query_id, CASE WHEN turn % 4 = 0 THEN 'own' ELSE '' END AS attribute FROM conversations WHERE role = 'user'),
        b AS (SELECT query_id, r.role || ':' || r.turn AS found, length(r.text) % 11 AS score FROM t JOIN conversations r ON r.conv_id = t.conv_id AND r.turn BETWEEN t.turn - 3 AND t.turn - 1
              WHERE r.role = 'assistant' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, found DESC) = 1)
        SELECT query_id, CASE WHEN attribute = '' AND score >= 5 THEN found ELSE attribute END AS attribute FROM t LEFT JOIN b USING (query_id)""",
    "q_template_values": "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN turn::VARCHAR WHEN 1 THEN role END AS value FROM conversations",
    "q_jsonl": "SELECT conv_id, turn, role, sha1(text) AS digest FROM conversations",
    "q_snapshot": f"WITH {_VERSIONS} SELECT status, version, 'warm' AS tier, count(*) AS n, max(seq) AS last_seq FROM v WHERE status IS NOT NULL GROUP BY ALL",
}
