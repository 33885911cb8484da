"""The versioned record ledger, as windows over an append-only log.

A log row is (seq, op, entity, attribute, value, text, origin, slot, ...) with op one of
write, retract. Nothing is updated in place: versions, statuses and indexes are views of
the log, so a rerun over the same log gives the same ledger, and rows of different keys
never meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

ACTIVE, SUPERSEDED, RETRACTED, QUARANTINED = "active", "superseded", "retracted", "quarantined"
#: Fixed values of the admission gate.
LEAST_IMPORTANCE, LEAST_CONFIDENCE = 0.50, 0.25


def admitted(importance: Column, confidence: Column, force: Column) -> Column:
    """Whether a write is trusted; others are quarantined."""
    return force | ~((importance < LEAST_IMPORTANCE) | (confidence < LEAST_CONFIDENCE))


def versions(log: DataFrame, keys: Sequence[str] = ("entity", "attribute"), seq: str = "seq", op: str = "op", value: str = "value") -> DataFrame:
    """The log's rows with action, version, status and the seq they supersede.

    Per key, in the order of seq: a retract ends the active version and starts the count
    anew; a write of the active value is a duplicate; any other write is the next version. An
    inserted row is superseded by the next one, or else retracted by the next retract. seq
    must be different within a key.
    """
    own = W.partitionBy(*keys).orderBy(seq)
    whole = W.partitionBy(*keys)
    is_retract = F.col(op) == "retract"
    out = log.withColumn("_epoch", F.sum(is_retract.cast("int")).over(own)).withColumn("_last_retract", F.max(F.when(is_retract, F.col(seq))).over(whole))
    in_epoch = W.partitionBy(*keys, "_epoch", op).orderBy(seq)
    fresh = ~F.col(value).eqNullSafe(F.lag(value).over(in_epoch)) | (F.row_number().over(in_epoch) == 1)
    out = out.withColumn("_fresh", (F.col(op) == "write") & fresh)
    out = out.withColumn("version", F.when(F.col(op) == "write", F.sum(F.col("_fresh").cast("int")).over(in_epoch) - 1))
    made = W.partitionBy(*keys, "_epoch", "_fresh").orderBy(seq)
    out = out.withColumn("_next", F.lead(seq).over(made)).withColumn("_before", F.lag(seq).over(made))
    status = (
        F.when(F.col("_next").isNotNull(), SUPERSEDED)
        .when(F.col("_last_retract").isNotNull() & (F.col(seq) < F.col("_last_retract")), RETRACTED).otherwise(ACTIVE)
    )
    action = F.when(is_retract, "retract").when(~F.col("_fresh"), "duplicate").when(F.col("version") > 0, "updated").otherwise("inserted")
    return out.select(
        *log.columns, action.alias("action"), F.col("version").cast("int").alias("version"), F.when(F.col("_fresh"), status).alias("status"),
        F.when(F.col("_fresh"), F.col("_before")).alias("supersedes"),
    )


def merged_evidence(rows: DataFrame, keys: Sequence[str] = ("entity", "attribute")) -> DataFrame:
    """Of each version the best confidence and importance of its writes, duplicates included."""
    return rows.where("action in ('inserted', 'updated', 'duplicate')").groupBy(*keys, "version").agg(
        F.max("confidence").alias("confidence"), F.max("importance").alias("importance"), F.count("*").alias("n_writes")
    )


def active(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("status") == ACTIVE)


def first_by_text(log: DataFrame, text: str = "text", seq: str = "seq") -> DataFrame:
    """Rows with the seq of the first row of the same text, letter case and outer space aside."""
    key = F.lower(F.trim(F.col(text)))
    return log.withColumn("first_seq", F.min(seq).over(W.partitionBy(key)))


def by_slot(log: DataFrame, slot: str = "slot", seq: str = "seq") -> DataFrame:
    """Of rows in slots (0 and up) the last of each is active; the rest are superseded by the next."""
    own = W.partitionBy(slot).orderBy(seq)
    return (
        log.where(F.col(slot) >= 0).withColumn("superseded_by", F.lead(seq).over(own))
        .withColumn("status", F.when(F.col("superseded_by").isNull(), ACTIVE).otherwise(SUPERSEDED))
    )


def absorb_unidentified(records: DataFrame, origin: str = "origin", seq: str = "seq") -> DataFrame:
    """Status after a structured record of one turn absorbed the turn's earlier unidentified ones."""
    named = (F.col("entity") != "") & (F.col("attribute") != "")
    last = F.max(F.when(named, F.col(seq))).over(W.partitionBy(origin))
    taken = (F.col(origin) != "") & ~named & (F.col("status") == ACTIVE) & (F.col(seq) < last)
    return records.withColumn("status", F.when(F.coalesce(taken, F.lit(False)), SUPERSEDED).otherwise(F.col("status")))


def retract_origins(records: DataFrame, origins: DataFrame, origin: str = "origin") -> DataFrame:
    """Records with the active ones of the named turns retracted; a blank turn matches none."""
    gone = origins.where(F.col(origin) != "").select(F.col(origin)).distinct().withColumn("_gone", F.lit(True))
    hit = F.coalesce("_gone", F.lit(False)) & (F.col("status") == ACTIVE)
    return records.join(gone, origin, "left").withColumn("status", F.when(hit, RETRACTED).otherwise(F.col("status"))).drop("_gone")


def edit(records: DataFrame, edits: DataFrame, key: str = "record_id") -> DataFrame:
    """Edits (key, entity, attribute, value, text; null keeps) as new versions of active records.

    Returns the old rows, superseded where edited, and the new ones with supersedes set.
    """
    fields = ("entity", "attribute", "value", "text")
    new = edits.select(key, *(F.col(c).alias(f"_{c}") for c in fields))
    hit = records.where(F.col("status") == ACTIVE).join(new, key)
    made = hit.select(*[
        F.coalesce(f"_{c}", c).alias(c) if c in fields else F.concat(key, F.lit("#"), F.col("version") + 1).alias(c) if c == key
        else (F.col("version") + 1).alias(c) if c == "version" else F.col(key).alias(c) if c == "supersedes" else F.col(c)
        for c in records.columns
    ])
    touched = edits.select(key).distinct().withColumn("_hit", F.lit(True))
    old = records.join(touched, key, "left").withColumn(
        "status", F.when(F.col("_hit") & (F.col("status") == ACTIVE), SUPERSEDED).otherwise(F.col("status"))
    ).select(*records.columns)
    return old.unionByName(made)


def approve(log: DataFrame, approvals: DataFrame, seq: str = "seq") -> DataFrame:
    """The log with approved quarantined writes trusted from the approval's seq on.

    approvals is (seq, approved_seq). Rows that aren't trusted and aren't approved are left out.
    """
    later = approvals.select(F.col(seq), F.col("approved_seq").alias("_at"))
    out = log.join(later, seq, "left").where(F.col("trusted") | F.col("_at").isNotNull())
    return out.withColumn(seq, F.when(F.col("trusted"), F.col(seq)).otherwise(F.col("_at"))).drop("_at")


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the order given: upserts, latest per key, first wins."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def tiers(pages: DataFrame, hot: int = 8, resident: int = 64, order: Sequence[str] = ("importance", "last_access", "n_records"), page: str = "page_id") -> DataFrame:
    """Pages with tier: the first `hot` hot, those beyond `resident` cold, the rest warm.

    The ranks come from the top `resident` rows alone, taken before any global numbering.
    """
    by = [F.col(c).desc() for c in order] + [F.col(page)]
    top = pages.orderBy(*by).limit(resident)
    ranked = top.withColumn("_rank", F.row_number().over(W.orderBy(*by))).select(page, "_rank")
    return pages.join(ranked, page, "left").withColumn(
        "tier", F.when(F.col("_rank") <= hot, "hot").when(F.col("_rank").isNotNull(), "warm").otherwise("cold")
    ).drop("_rank")


def consolidation_plan(pages: DataFrame, target: int, capacity: int = 32, page: str = "page_id") -> DataFrame:
    """(page_id, move): the pages of least importance and size beyond the target number move.

    Pages are derived from their key here, so a plan only says which to merge. The pages that stay
    are a top `target`, so no task numbers all pages.
    """
    stay = pages.orderBy(F.col("importance").desc(), F.col("n_records").desc(), F.col(page)).limit(target).select(page, F.lit(True).alias("_stays"))
    return pages.join(stay, page, "left").withColumn("move", F.col("_stays").isNull() & (F.col("n_records") < capacity)).drop("_stays")


def page_of(key: Column, pages: int) -> Column:
    """The page of a record: a hash of its key. It stands for placement by nearest centroid."""
    return (T.hash_number(key) % pages).cast("int")


def counts(records: DataFrame, *by: str) -> DataFrame:
    """Records and distinct keys by status, tier or whatever columns are given."""
    return records.groupBy(*by).agg(F.count("*").alias("n_records"), F.count_distinct("entity", "attribute").alias("n_keys"))


def audit(rows: DataFrame, edges: DataFrame, pages: DataFrame, keys: Sequence[str] = ("entity", "attribute"), seq: str = "seq", capacity: int = 32) -> DataFrame:
    """(issue, n): what a sound ledger has none of.

    Keys with two active rows, actives that a supersedes link names, links to rows that aren't
    there, related ids (edges: seq, related) that aren't there, and pages over capacity.
    """
    live = active(rows)
    two = live.groupBy(*keys).count().where("count > 1").select(F.lit("two_active").alias("issue"))
    links = rows.where("supersedes is not null").select(F.col("supersedes").alias(seq))
    stale = live.join(links, seq, "left_semi").select(F.lit("active_superseded").alias("issue"))
    lost = links.join(rows.select(seq), seq, "left_anti").select(F.lit("lost_predecessor").alias("issue"))
    dangling = edges.select(F.col("related").alias(seq)).join(rows.select(seq), seq, "left_anti").select(F.lit("dangling_related").alias("issue"))
    over = pages.where(F.col("n_records") > capacity).select(F.lit("over_capacity").alias("issue"))
    return two.union(stale).union(lost).union(dangling).union(over).groupBy("issue").agg(F.count("*").alias("n"))
