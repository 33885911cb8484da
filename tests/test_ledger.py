"""The ledger against a fold of its rules, row by row, on random logs."""

import random

import pandas as pd
from pyspark.sql import functions as F

from palimpsest.operators import ledger as L
from palimpsest.operators import retrieval as R
from palimpsest.streaming import ledger_stream


def fold(log):
    live, out = {}, {}
    for seq, op, e, a, v in log:
        held = live.get((e, a))
        if op == "retract":
            if held:
                out[held[0]][1] = "retracted"
            live.pop((e, a), None)
            out[seq] = [None, None]
        elif held and held[1] == v:
            out[seq] = [None, None]
        else:
            if held:
                out[held[0]][1] = "superseded"
            version = held[2] + 1 if held else 0
            live[e, a] = (seq, v, version)
            out[seq] = [version, "active"]
    return {k: tuple(v) for k, v in out.items()}


def random_log(seed, n=200):
    rng = random.Random(seed)
    return [(i, "retract" if rng.random() < 0.15 else "write", rng.choice("xy"), rng.choice("pq"), rng.choice("123")) for i in range(n)]


def test_versions_follow_the_rules(spark):
    for seed in range(4):
        log = random_log(seed)
        df = spark.createDataFrame(log, "seq long, op string, entity string, attribute string, value string")
        got = {r.seq: (r.version if r.status else None, r.status) for r in L.versions(df).collect()}
        assert got == fold(log)


def test_one_active_row_for_a_key(spark):
    df = spark.createDataFrame(random_log(9), "seq long, op string, entity string, attribute string, value string")
    rows = L.versions(df)
    assert L.active(rows).groupBy("entity", "attribute").count().where("count > 1").count() == 0
    none = spark.createDataFrame([], "seq long, related long")
    pages = spark.createDataFrame([(1, 40), (2, 3)], "page_id int, n_records int")
    assert [(r.issue, r.n) for r in L.audit(rows.where("status is not null"), none, pages).collect()] == [("over_capacity", 1)]


def test_quarantine_waits_for_approval(spark):
    log = spark.createDataFrame([(1, "write", "e", "a", "x", True), (2, "write", "e", "a", "y", False)], "seq long, op string, entity string, attribute string, value string, trusted boolean")
    none = spark.createDataFrame([], "seq long, approved_seq long")
    assert [r.value for r in L.active(L.versions(L.approve(log, none))).collect()] == ["x"]
    yes = spark.createDataFrame([(2, 7)], "seq long, approved_seq long")
    assert [r.value for r in L.active(L.versions(L.approve(log, yes))).collect()] == ["y"]


def test_blank_origin_forgets_nothing(spark):
    rows = spark.createDataFrame([("a", "", "active"), ("b", "t", "active"), ("c", "t", "superseded")], "record_id string, origin string, status string")
    gone = spark.createDataFrame([("",), ("t",)], "origin string")
    got = {r.record_id: r.status for r in L.retract_origins(rows, gone).collect()}
    assert got == {"a": "active", "b": "retracted", "c": "superseded"}


def test_address_rules(spark):
    cases = [
        ("训练用户00006 的 档案代号", "训练用户00006", "档案代号", "", True),
        ("训练用户00006 的 档案代号", "评估用户00006", "档案代号", "", False),
        ("where is parse_args", "tool.py", "symbol:parse_args", "", True),
        ("where is parse_args in other.py", "tool.py", "symbol:parse_args", "", False),
        ("anything", "", "x", "", False),
    ]
    from palimpsest.functions import text as T

    df = spark.createDataFrame([(*c[:4], i) for i, c in enumerate(cases)], "q string, e string, a string, v string, i int")
    match = R.matches_address(F.col("q"), T.tokens(F.col("q")), F.col("e"), F.col("a"), F.col("v"))
    assert [r.m for r in df.select("i", match.alias("m")).orderBy("i").collect()] == [c[4] for c in cases]


def test_streamed_ledger_agrees(spark, tmp_path):
    log = random_log(5, 120)
    schema = "seq long, op string, entity string, attribute string, value string"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = ledger_stream.ledger_versions(stream).writeStream.format("memory").queryName("ledger_rows").option("checkpointLocation", str(tmp_path / "cp")).start()
    for i in range(3):
        spark.createDataFrame(log[40 * i : 40 * i + 40], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query.processAllAvailable()
    query.stop()
    got = {r.seq: (r.action, r.version, r.supersedes) for r in spark.table("ledger_rows").collect()}
    batch = L.versions(spark.createDataFrame(log, schema)).collect()
    assert got == {r.seq: (r.action, r.version, r.supersedes) for r in batch}


def test_streamed_windows(spark, tmp_path):
    rows = pd.DataFrame({"ts": pd.to_datetime(["2024-01-01 01:00", "2024-01-01 02:00", "2024-01-03 00:00"]), "user": ["a", "a", "b"], "value": [1.0, 2.0, 4.0]})
    spark.createDataFrame(rows).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, user string, value double").parquet(str(tmp_path / "in"))
    query = ledger_stream.windowed_counts(stream, "user").writeStream.format("memory").outputMode("complete").queryName("window_rows").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.user, r.n, r.total) for r in spark.table("window_rows").collect()) == [("a", 2, 3.0), ("b", 1, 4.0)]
