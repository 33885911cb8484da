"""Text-first versions and slot banks against folds of their rules, row by row."""

import random

import numpy as np
import pytest

from palimpsest.operators import folds
from palimpsest.operators.components import components
from palimpsest.operators.learned import PairMlp
from palimpsest.streaming import slot_stream

LOG = "seq long, op string, entity string, attribute string, value string, text string, extra string, version string"


def by_hand(log):
    """All records in one list; every write looks through all of it."""
    records, out = [], {}
    for seq, op, entity, attribute, value, text in log:
        entity, attribute, value, text = (((x or "").strip(" ")).lower() for x in (entity, attribute, value, text))
        key = (entity, attribute) if entity and attribute else None
        mine = next((r for r in records if r["status"] == "active" and key and r["key"] == key), None)
        if op == "retract":
            if mine:
                mine["status"] = "retracted"
            out[seq] = ("retract", None, None, None)
            continue
        same = next((r for r in records if r["status"] == "active" and text and r["text"] == text), None)
        if same is None and mine and mine["value"] == value:
            same = mine
        if same:
            out[seq] = ("duplicate", same["version"], None, same["seq"])
            continue
        if mine:
            mine["status"] = "superseded"
        records.append({"seq": seq, "key": key, "value": value, "text": text, "status": "active", "version": mine["version"] + 1 if mine else 0})
        out[seq] = ("updated" if mine else "inserted", records[-1]["version"], mine["seq"] if mine else None, None)
    status = {r["seq"]: r["status"] for r in records}
    return {seq: (a, v, status.get(seq), s, d) for seq, (a, v, s, d) in out.items()}


def random_log(seed, n=300):
    rng = random.Random(seed)
    some = lambda *x: rng.choice(x)
    keys, texts = (3, 5) if seed % 2 else (12, 40)  # few keys that all share texts, or many that share some
    return [(i * 3, "retract" if rng.random() < 0.12 else "write", some("", None, *(f"E{k}" for k in range(keys)), *(f" e{k} " for k in range(keys))), some("a", "B", "b ", ""), some("1", "2", "x", None),
             some("", " ", None, *(f"Text {t}" for t in range(texts)), *(f"text {t} " for t in range(texts)))) for i in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_text_first_versions_follow_the_rules(spark, seed):
    log = random_log(seed)
    rows = [(*r, "x", "v") for r in log]
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, LOG).drop("version").repartition(3)
    got = {r["seq"]: (r["action"], r["version"], r["status"], r["supersedes"], r["duplicate_of"]) for r in folds.text_first_versions(df).collect()}
    assert got == by_hand(log)


def test_a_hot_component_is_folded_batch_by_batch(spark):
    """Two thirds of the rows are of keys that one text ties together."""
    log = random_log(7, 600) + [(10_000 + i, "write", f"h{i % 50}", "a", str(i % 7), "the same text" if i % 9 == 0 else f"t{i % 90}") for i in range(1200)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        got = {r["seq"]: (r["action"], r["version"], r["status"], r["supersedes"], r["duplicate_of"]) for r in folds.text_first_versions(spark.createDataFrame(log, "seq long, op string, entity string, attribute string, value string, text string")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == by_hand(log)


def test_no_rows_and_no_texts(spark):
    empty = spark.createDataFrame([], LOG).drop("version")
    assert folds.text_first_versions(empty).collect() == []
    bare = spark.createDataFrame([(1, "write", None, None, None, None), (2, "write", None, None, None, None), (3, "retract", None, None, None, None)], "seq long, op string, entity string, attribute string, value string, text string")
    assert sorted((r["seq"], r["action"], r["status"]) for r in folds.text_first_versions(bare).collect()) == [(1, "inserted", "active"), (2, "inserted", "active"), (3, "retract", None)]


@pytest.mark.parametrize("kind", ["chain", "backward", "star", "random", "loops"])
def test_components(spark, kind):
    rng = random.Random(4)
    edges = {
        "chain": [(i, i + 1) for i in range(200)], "backward": [(i + 1, i) for i in range(200, 0, -1)] + [(1, 500)], "star": [(0, i) for i in range(1, 150)] + [(-5, 7)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(160)], "loops": [(3, 3), (4, 5), (5, 4), (4, 5), (9, None), (None, None)],
    }[kind]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for u, v in edges:
        if u is not None and v is not None:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in list(parent)}


def scorer(dims=4):
    rng = np.random.default_rng(2)
    return PairMlp(((rng.normal(0, 1, (4 * dims, 6)), np.zeros(6)), (rng.normal(0, 2, (6, 1)), np.ones(1))))


def slots_by_hand(rows, slots, score):
    """The rule over lists that grow; nothing is shared with SlotBank but the numbers."""
    out, users = {}, {}
    for user, seq, op, tokens, vector, fact in sorted(rows, key=lambda r: r[1]):
        u = users.setdefault(user, {"slots": {}, "known": set(), "clock": 0})
        bank = u["slots"]
        if not tokens:
            out[user, seq] = ("empty", None)
            continue
        share = {i: len([t for t in s["tokens"] if t in tokens]) / max(1.0, np.sqrt(len(s["tokens"]) * len(tokens))) for i, s in bank.items()}
        best = min(bank, key=lambda i: (-share[i], i), default=None)
        top = share[best] if best is not None else -1.0
        told = {i: float(score(np.array([vector]), np.array([s["vector"]]))[0]) for i, s in bank.items() if score and vector is not None and s["vector"] is not None}
        near = min(told, key=lambda i: (-told[i], i), default=None)
        if op == "forget":
            if near is not None and told[near] >= top:
                best, top = near, told[near]
            if best is not None and (top >= 0.22 or near is not None and top >= 0.65):
                u["known"].discard(bank.pop(best)["fact"])
                out[user, seq] = ("forgotten", best)
            else:
                out[user, seq] = ("missed", None)
            continue
        equal = [i for i in sorted(bank) if bank[i]["tokens"] == tokens]
        if not equal and near is not None:
            if told[near] >= 0.65:
                best = near
            if told[near] >= 0.95 and not fact:
                fact = bank[best]["fact"]
        if equal:
            action, at = "touched", equal[0]
        elif fact and fact in u["known"] and best is not None and (told[near] >= 0.95 if near is not None else top >= 0.30):
            action, at = "updated", best
        elif len(bank) < slots:
            action, at = "inserted", min(set(range(slots)) - set(bank))
        else:
            action, at = "replaced", min(bank, key=lambda i: bank[i]["age"])
        u["clock"] += 1
        bank[at] = {"tokens": tokens, "vector": vector, "fact": fact, "age": u["clock"]}
        if fact:
            u["known"].add(fact)
        out[user, seq] = (action, at)
    return out


def slot_rows(seed, n=500):
    rng = random.Random(seed)
    words = ["my", "is", "the", "city", "fruit", "red", "Bonn", "work"]
    say = lambda: [rng.choice(words) for _ in range(rng.randrange(0, 6))]
    return [(rng.choice([1, 1, 1, 2, 3]), i, "forget" if rng.random() < 0.1 else "write", rng.choice([say(), say(), None]) if rng.random() < 0.9 else ["my", "city", "is"],
             [rng.gauss(0, 1) for _ in range(4)] if rng.random() < 0.9 else None, rng.choice([None, "", "u::city", "u::fruit", "u::work"])) for i in range(n)]


SLOTS = "user_id long, seq long, op string, tokens array<string>, vector array<double>, fact string"


@pytest.mark.parametrize("seed,learned", [(1, False), (2, True), (3, True)])
def test_slot_bank_follows_the_rules(spark, seed, learned):
    rows, score = slot_rows(seed), scorer() if learned else None
    expected = slots_by_hand(rows, 4, score)
    assert {a for a, _ in expected.values()} >= {"touched", "updated", "inserted", "replaced", "forgotten", "empty"}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 13)
    try:
        found = folds.slot_bank(spark.createDataFrame(rows, SLOTS).repartition(3), 4, score).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r["user_id"], r["seq"]): (r["action"], r["slot"]) for r in found} == expected


def test_logs_without_vectors_facts_and_keys(spark):
    rows = spark.createDataFrame([(None, 1, ["a"]), (None, 2, ["a"]), (5, 1, ["b"])], "user_id long, seq long, tokens array<string>")
    assert sorted((str(r["user_id"]), r["seq"], r["action"]) for r in folds.slot_bank(rows).collect()) == [("5", 1, "inserted"), ("None", 1, "inserted"), ("None", 2, "touched")]


def test_stream_equals_batch(spark, tmp_path):
    """Three files of rows in order are three batches; within a file rows are in any order."""
    rows, score = slot_rows(9, 300), scorer()
    for i in range(3):
        part = rows[i * 100 : (i + 1) * 100]
        random.Random(i).shuffle(part)
        spark.createDataFrame(part, SLOTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    before = spark.conf.get(slot_stream.STATE_STORE[0])
    spark.conf.set(*slot_stream.STATE_STORE)
    try:
        stream = spark.readStream.schema(SLOTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
        query = slot_stream.slot_banks(stream, 4, score).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        query.outputMode("append").trigger(availableNow=True).start().awaitTermination(300)
    finally:
        spark.conf.set(slot_stream.STATE_STORE[0], before)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r["user_id"], r["seq"]): (r["action"], r["slot"]) for r in got} == slots_by_hand(rows, 4, score)
    assert len({f.name for f in (tmp_path / "state" / "commits").iterdir() if f.name.isdigit()}) >= 3


def test_slot_query_takes_all_events(spark, sf_dir):
    from palimpsest.plans import fold_queries

    rows = [(r["user_id"], r["seq"], r["op"], list(r["tokens"]), list(r["vector"]) if r["vector"] is not None else None, r["fact"]) for r in fold_queries.event_slots(spark, sf_dir).collect()]
    got = {(r["user_id"], r["seq"]): (r["action"], r["slot"]) for r in fold_queries.q_slot_bank(spark, sf_dir).collect()}
    assert len(rows) == spark.read.parquet(f"{sf_dir}/events.parquet").count() and got == slots_by_hand(rows, 6, fold_queries.slot_scorer())
    assert {a for a, _ in got.values()} >= {"updated", "inserted", "replaced", "forgotten"}
