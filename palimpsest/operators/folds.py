"""Rules whose every step depends on the steps before, folded in order with bounded state.

Rows that can touch each other share a key; tasks get whole keys, sorted by a sort that spills,
and read them batch by batch, so a key with a third of all rows takes one task's time and the
memory of its state, never of its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .ledger import ACTIVE, RETRACTED, SUPERSEDED

#: Least token overlaps of an update and of a forgetting, least learned scores of a match and of an update.
UPDATE_OVERLAP, FORGET_OVERLAP, LEARNED_MATCH, LEARNED_UPDATE = 0.30, 0.22, 0.65, 0.95


def conflict_key(entity: Column, attribute: Column) -> Column:
    """The key under which one record is active at a time; null without entity or attribute."""
    e, a = F.lower(F.trim(entity)), F.lower(F.trim(attribute))
    return F.when((e != "") & (a != ""), F.concat(e, F.lit("::"), a))


def _text_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (component, seq, op, key, value, text) in order to (seq, action, version, ref).

    ref is the seq that a row supersedes, retracts or repeats. State: the component's active
    records by key, and by text.
    """
    now: object = object()
    live: dict[str, tuple[int, int, str, str | None]] = {}
    texts: dict[str, tuple[int, int]] = {}
    for batch in batches:
        out = []
        for component, seq, op, key, value, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if component != now:
                now, live, texts = component, {}, {}
            old = live.get(key) if key is not None else None
            if op == "retract":
                if old:
                    del live[key]
                    if old[3] is not None:
                        texts.pop(old[3], None)
                out.append((seq, "retract", None, old[0] if old else None))
                continue
            same = texts.get(text) if text is not None else None
            if same is None and old and old[2] == value:
                same = old[:2]
            if same:
                out.append((seq, "duplicate", same[1], same[0]))
                continue
            version = old[1] + 1 if old else 0
            if old and old[3] is not None:
                texts.pop(old[3], None)
            if key is not None:
                live[key] = (seq, version, value, text)
            if text is not None:
                texts[text] = (seq, version)
            out.append((seq, "updated" if old else "inserted", version, old[0] if old else None))
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64())
        columns = zip(*out, strict=True) if out else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["seq", "action", "version", "ref"])


def text_first_versions(log: DataFrame, entity: str = "entity", attribute: str = "attribute", value: str = "value", text: str = "text", seq: str = "seq", op: str = "op") -> DataFrame:
    """The log's rows with action, version, status, supersedes and duplicate_of, where an equal text of any key wins.

    In the order of seq, over all keys: a write whose text, letter case and outer space aside, is
    that of an active record is a duplicate of it, whatever its key; else one whose value is that of
    the active record of its key is a duplicate; any other is the next version of its key, or the
    first. A retract ends the key's active record, and its next version is 0 again. Rows without
    entity or attribute have no key: only their text can make them duplicates, and nothing ends
    them. Blank and null texts are no texts; null values are blank ones. op is write or retract; seq
    must be different for each row.

    Keys that share a text depend on each other, so a fold runs over components of keys: linked are
    the least and each other key of a text that several keys have. A component's state is its
    active records; texts are held as digests. Other columns come back as they are.
    """
    key, folded = conflict_key(F.col(entity), F.col(attribute)), F.lower(F.trim(text))
    digest = F.when(folded != "", F.sha2(folded, 256))
    rows = log.select(F.col(seq).cast("long").alias("seq"), F.col(op).alias("op"), key.alias("key"), F.coalesce(F.lower(F.trim(value)), F.lit("")).alias("value"), digest.alias("text"))
    # a row without key belongs to its text, one without either to itself
    rows = rows.withColumn("node", F.when(F.col("key").isNotNull(), F.xxhash64(F.lit("k"), "key")).when(F.col("text").isNotNull(), F.xxhash64(F.lit("t"), "text")).otherwise(F.xxhash64(F.lit("r"), "seq")))
    said = rows.where("op = 'write' and text is not null").select("text", "node").distinct()
    several = said.groupBy("text").agg(F.min("node").alias("u"), F.max("node").alias("_most")).where("u < _most").select("text", "u")
    linked = components(said.join(several, "text").select("u", F.col("node").alias("v")))
    rows = rows.join(linked, "node", "left").select(F.coalesce("component", "node").alias("component"), "seq", "op", "key", "value", "text")
    done = rows.repartition("component").sortWithinPartitions("component", "seq").mapInArrow(_text_first, "seq long, action string, version int, ref long")
    done = done.withColumns({"_is": F.lit(0), "_end": F.lit(None).cast("string")})
    ends = done.where("ref is not null and action in ('updated', 'retract')")
    ends = ends.select(F.col("ref").alias("seq"), F.lit(None).cast("string").alias("action"), F.lit(None).cast("int").alias("version"), F.lit(None).cast("long").alias("ref"), F.lit(1).alias("_is"),
                       F.when(F.col("action") == "updated", SUPERSEDED).otherwise(RETRACTED).alias("_end"))
    whole = done.union(ends).groupBy("seq").agg(*(F.max(c).alias(c) for c in ("action", "version", "ref", "_end")))
    made = F.col("action").isin("inserted", "updated")
    whole = whole.select(
        F.col("seq").alias("_seq"), "action", "version", F.when(made, F.coalesce("_end", F.lit(ACTIVE))).alias("status"), F.when(F.col("action") == "updated", F.col("ref")).alias("supersedes"),
        F.when(F.col("action") == "duplicate", F.col("ref")).alias("duplicate_of"),
    )
    return log.join(whole, F.col(seq) == F.col("_seq")).drop("_seq")


@dataclass
class Slot:
    tokens: list[str]
    vector: np.ndarray | None
    fact: str | None
    age: int


@dataclass
class SlotBank:
    """A fixed number of slots that writes fill, update and evict, and that requests to forget clear.

    score, if given, is a learned scorer of a matrix of query vectors and one of slot vectors.
    """

    slots: int = 16
    score: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
    held: list[Slot | None] = field(default_factory=list)
    facts: set[str] = field(default_factory=set)
    writes: int = 0

    def __post_init__(self) -> None:
        self.held = self.held or [None] * self.slots

    def _overlap(self, tokens: list[str]) -> tuple[float, int]:
        """The slot with the largest share of equal tokens, the first of equals; (-1, 0) if none is held."""
        new, best = set(tokens), (-1.0, 0)
        for i, s in enumerate(self.held):
            if s is not None:
                shared = sum(t in new for t in s.tokens) / max(1.0, (len(s.tokens) * max(1, len(tokens))) ** 0.5)
                if shared > best[0]:
                    best = shared, i
        return best

    def _learned(self, vector: np.ndarray | None) -> tuple[float, int] | None:
        at = [i for i, s in enumerate(self.held) if s is not None and s.vector is not None]
        if self.score is None or vector is None or not at:
            return None
        scores = self.score(np.repeat(vector[None], len(at), axis=0), np.stack([self.held[i].vector for i in at]))
        return float(scores.max()), at[int(scores.argmax())]

    def write(self, tokens: list[str], vector: np.ndarray | None, fact: str | None) -> tuple[str, int, float, float | None]:
        """(action, slot, overlap, learned score) of a write.

        The matching slot is that of equal tokens, else of the largest overlap, else of a learned
        score of a match. It is overwritten if tokens are equal, or if the fact is known and the
        learned score, or without one the overlap, is that of an update; a write without a fact takes
        that of a slot with such a score. Any other write takes a free slot, or the oldest.
        """
        overlap, slot = self._overlap(tokens)
        learned = None
        exact = next((i for i, s in enumerate(self.held) if s is not None and s.tokens == tokens), None)
        if exact is not None:
            overlap, slot = 1.0, exact
        else:
            learned = self._learned(vector)
            if learned and learned[0] >= LEARNED_MATCH:
                slot = learned[1]
        matched = self.held[slot]
        if fact is None and learned and learned[0] >= LEARNED_UPDATE and matched is not None:
            fact = matched.fact
        updates = fact is not None and fact in self.facts and (learned[0] >= LEARNED_UPDATE if learned else overlap >= UPDATE_OVERLAP)
        free = next((i for i, s in enumerate(self.held) if s is None), None)
        if exact is not None:
            action = "touched"
        elif updates and matched is not None:
            action = "updated"
        elif free is not None:
            action, slot = "inserted", free
        else:
            action, slot = "replaced", min(range(self.slots), key=lambda i: self.held[i].age)
        self.writes += 1
        self.held[slot] = Slot(tokens, vector, fact, self.writes)
        if fact is not None:
            self.facts.add(fact)
        return action, slot, overlap, learned[0] if learned else None

    def forget(self, tokens: list[str], vector: np.ndarray | None) -> tuple[str, int | None, float, float | None]:
        """Clears the slot of the largest overlap or learned score, if either is that of a match; its fact is known no more."""
        overlap, slot = self._overlap(tokens)
        learned = self._learned(vector)
        best = overlap
        if learned and learned[0] >= best:
            best, slot = learned
        if self.held[slot] is None or best < FORGET_OVERLAP and not (learned and best >= LEARNED_MATCH):
            return "missed", None, overlap, learned[0] if learned else None
        self.facts.discard(self.held[slot].fact)
        self.held[slot] = None
        return "forgotten", slot, overlap, learned[0] if learned else None

    def step(self, op: str, tokens: list[str] | None, vector: list[float] | None, fact: str | None) -> tuple[str, int | None, float, float | None]:
        own = np.asarray(vector, dtype=np.float64) if vector is not None else None
        if not tokens:
            return "empty", None, -1.0, None
        return self.forget(list(tokens), own) if op == "forget" else self.write(list(tokens), own, fact or None)


SLOT_ROWS = "seq long, action string, slot int, overlap double, learned double"


def slot_log(log: DataFrame, key: str) -> DataFrame:
    """The columns that the fold reads; those that the log lacks are null, and all rows write."""
    kinds = {"op": "string", "tokens": "array<string>", "vector": "array<double>", "fact": "string"}
    own = [F.col(c).cast(t).alias(c) if c in log.columns else F.lit("write" if c == "op" else None).cast(t).alias(c) for c, t in kinds.items()]
    return log.select(F.col(key).cast("long").alias(key), F.col("seq").cast("long").alias("seq"), *own)


def slot_bank(log: DataFrame, slots: int = 16, score: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, key: str = "user_id") -> DataFrame:
    """Each key's rows (seq, op, tokens, vector, fact) folded into its bank: (key, seq, action, slot, overlap, learned).

    op is write or forget, by default write; tokens in their order, vector and fact may be null.
    Actions are those of SlotBank; a row without tokens is `empty` and changes nothing. Rows
    of a null key are one key. seq must be different within a key.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = object()  # no key is equal to it
        bank = SlotBank(slots, score)
        for batch in batches:
            out = []
            for k, seq, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != now:
                    now, bank = k, SlotBank(slots, score)
                out.append((k, seq, *bank.step(*rest)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.float64())
            columns = zip(*out, strict=True) if out else ([],) * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=[key, "seq", "action", "slot", "overlap", "learned"])

    rows = slot_log(log, key)
    return rows.repartition(key).sortWithinPartitions(key, "seq").mapInArrow(fold, f"{key} long, {SLOT_ROWS}")
