"""Learned scorers over vector pairs, fitted elsewhere or here on a bounded table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import held


@dataclass(frozen=True)
class PairMlp:
    """A small network over a query and a key vector.

    features says what it sees: 'gated' is [q, k, q - k] added to a cosine by a gate, 'text' is
    [q, k, q k, |q - k|]. layers are (weights, bias) of each layer; the last has one output.
    """

    layers: tuple[tuple[np.ndarray, np.ndarray], ...]
    features: str = "text"
    gate: float = 0.5

    def __call__(self, q: np.ndarray, k: np.ndarray) -> np.ndarray:
        x = np.concatenate([q, k, q - k] if self.features == "gated" else [q, k, q * k, np.abs(q - k)], axis=1)
        for i, (w, b) in enumerate(self.layers):
            x = x @ w + b
            if i < len(self.layers) - 1:
                x = np.maximum(x, 0)
        out = x[:, 0]
        if self.features == "gated":
            length = np.linalg.norm(q, axis=1) * np.linalg.norm(k, axis=1)
            out = self.gate * np.where(length > 0, (q * k).sum(axis=1) / np.where(length > 0, length, 1), 0) + (1 - self.gate) * out
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))

    def block(self, q: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The scores of every row of q with every row of k; what the first layer adds for either alone is made once."""
        if self.features == "gated":
            return self(np.repeat(q, len(k), axis=0), np.tile(k, (len(q), 1))).reshape(len(q), len(k))
        (w, b), d, out = self.layers[0], q.shape[1], np.empty((len(q), len(k)))
        left, right = q @ w[:d] + b, k @ w[d : 2 * d]
        for i, x in enumerate(q):
            h = np.concatenate([x * k, np.abs(x - k)], axis=1) @ w[2 * d :] + right + left[i]
            for w_next, b_next in self.layers[1:]:
                h = np.maximum(h, 0) @ w_next + b_next
            out[i] = h[:, 0]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def block_scores(queries: DataFrame, records: DataFrame, by: str, score: Callable[[np.ndarray, np.ndarray], np.ndarray], query_rows: int = 256, record_rows: int = 2_048) -> DataFrame:
    """(query_id, record_id, score) of every query (query_id, vector) with every record (record_id, vector) of equal `by`; null vectors score null.

    score takes two matrices and scores all their pairs. A task holds a block of queries and a block of records of a group, so a
    group of any size has bounded blocks; vectors go to a block once, not with each pair.
    """
    kinds = [t.schema[c].dataType.simpleString() for t, c in ((queries, "query_id"), (records, "record_id"))]

    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        n, ids = len(q) * len(r), [t.column(c).combine_chunks() for t, c in ((q, "query_id"), (r, "record_id"))]
        out, known = np.full((len(q), len(r)), np.nan), [t.column("vector").is_valid().to_numpy() for t in (q, r)]
        if known[0].any() and known[1].any():
            out[np.ix_(*known)] = score(*(np.array(t.column("vector").drop_null().to_pylist(), float) for t in (q, r)))
        at = np.arange(n)
        return pa.table({"query_id": ids[0].take(pa.array(at // max(1, len(r)))), "record_id": ids[1].take(pa.array(at % max(1, len(r)))), "score": pa.array(out.ravel(), from_pandas=True)})

    size = lambda t, rows, name: t.where(F.col(by).isNotNull()).groupBy(by).agg(F.ceil(F.count("*") / rows).cast("int").alias(name))
    parts = held(size(queries, query_rows, "_q").join(size(records, record_rows, "_r"), by))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    alias = lambda c: F.col(c).alias(c)  # noqa: E731  # both may come from one table
    q = queries.join(parts, by).select(alias("query_id"), alias("vector"), alias(by), own("query_id", "_q").alias("_q_part"), each("_r").alias("_r_part"))
    r = records.join(parts, by).select(alias("record_id"), alias("vector"), alias(by), own("record_id", "_r").alias("_r_part"), each("_q").alias("_q_part"))
    keys = (by, "_q_part", "_r_part")
    return q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInArrow(run, f"query_id {kinds[0]}, record_id {kinds[1]}, score double")


def scorer(score: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[Column, Column], Column]:
    """A column function of any batch scorer of two matrices; null vectors score null."""

    @F.pandas_udf("double")
    def run(q: pd.Series, k: pd.Series) -> pd.Series:
        ok = q.notna() & k.notna()
        out = pd.Series(np.nan, index=q.index, dtype="float64")
        if ok.any():
            out[ok] = score(np.stack(q[ok].to_numpy()).astype(float), np.stack(k[ok].to_numpy()).astype(float))
        return out.where(ok, None)

    return run


def fit_logistic(rows: DataFrame, vector: str, label: str, l2: float = 0.01, steps: int = 50):
    """Spark ML's logistic or softmax regression on an array column."""
    data = rows.select(array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"), F.col(label).cast("double").alias("label"))
    return LogisticRegression(regParam=l2, maxIter=steps).fit(data)


def predicted(model, rows: DataFrame, vector: str) -> DataFrame:
    """rows with prediction and probability (an array, by class)."""
    data = rows.withColumn("features", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    return model.transform(data).withColumn("probability", vector_to_array("probability")).drop("features", "rawPrediction")


def coverage_gate(asked: DataFrame, bank: DataFrame, vocabulary: DataFrame, share: float = 0.9) -> DataFrame:
    """asked (query_id, attribute) with covered: whether the bank (attribute) has it.

    If the bank holds less than `share` of the vocabulary (attribute), covered is null: the gate
    stands down.
    """
    held = bank.select("attribute").distinct()
    stands = vocabulary.select("attribute").distinct().join(held.withColumn("_in", F.lit(1)), "attribute", "left").agg((F.count("_in") >= share * F.count("*")).alias("_stands"))
    out = asked.join(held.withColumn("_covered", F.lit(True)), "attribute", "left").crossJoin(stands)  # one row
    return out.withColumn("covered", F.when(F.col("_stands"), F.coalesce("_covered", F.lit(False)))).drop("_stands", "_covered")


def inherited_keys(turns: DataFrame, scored: DataFrame, floor: float = 5.0) -> DataFrame:
    """turns (query_id, attribute) where a blank attribute takes that of the best record from `floor` on.

    Among records of one score that of the last attribute is the best.
    """
    best = scored.groupBy("query_id").agg(F.max_by("attribute", F.struct("score", "attribute")).alias("_attribute"), F.max("score").alias("_score"))
    own = F.when((F.col("attribute") == "") & (F.col("_score") >= floor), F.col("_attribute")).otherwise(F.col("attribute"))
    return turns.join(best, "query_id", "left").withColumn("attribute", own).drop("_attribute", "_score")


#: Fixed value: the share of a request's tokens that a record must have to be forgotten.
FORGET_SHARE = 0.22


def forget_matches(requests: DataFrame, records: DataFrame, threshold: float = FORGET_SHARE) -> DataFrame:
    """(query_id, record_id): of each request the record of most shared tokens, from the threshold on.

    Both have tokens; the join is on tokens, so only records that share one are compared.
    """
    asked = requests.select("query_id", F.explode("tokens").alias("t"), F.size("tokens").alias("n"))
    own = records.select("record_id", F.explode("tokens").alias("t"))
    shared = asked.join(own, "t").groupBy("query_id", "record_id", "n").agg(F.count("*").alias("k")).withColumn("score", F.col("k") / F.col("n"))
    best = shared.where(F.col("score") >= threshold).groupBy("query_id").agg(F.min_by("record_id", F.struct(-F.col("score"), "record_id")).alias("record_id"))
    return best


def hot_slots(log: DataFrame, slots: int = 16, key: str = "user_id") -> DataFrame:
    """A fold of each user's writes (seq, text) into a fixed number of slots: (key, seq, slot, action).

    A write of a text that a slot holds touches it; others take a free slot, or the one whose
    last write is oldest. A slot's turn depends on all writes before, so a user's log is sorted
    by (key, seq), which spills, and folded in order; a task holds one batch and one user's slots.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        now: object = object()  # no key is equal to it
        for batch in batches:
            keys, seqs, digests = (c.to_pylist() for c in batch.columns)
            at, actions = [], []
            for k, digest in zip(keys, digests, strict=True):
                if k != now:
                    held, now = {}, k
                if digest in held:
                    slot, action = held.pop(digest), "touched"
                elif len(held) < slots:
                    slot, action = len(held), "inserted"
                else:
                    slot, action = held.pop(next(iter(held))), "replaced"
                held[digest] = slot
                at.append(slot)
                actions.append(action)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(seqs, pa.int64()), pa.array(at, pa.int32()), pa.array(actions, pa.string())], names=[key, "seq", "slot", "action"])

    rows = log.select(F.col(key).cast("long"), F.col("seq").cast("long"), F.sha1(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("digest"))
    return rows.repartition(key).sortWithinPartitions(key, "seq").mapInArrow(fold, f"{key} long, seq long, slot int, action string")
