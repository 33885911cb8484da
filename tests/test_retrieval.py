"""Exact vector search, reranking and BM25 of pools against brute force."""

import math
import random
import statistics
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions import vectors as V
from palimpsest.operators import learned as N
from palimpsest.operators import retrieval as R
from palimpsest.plans import registry, retrieval_queries
from palimpsest.sources.files import read_table


def brute(queries, records, k):
    """{query_id: the k records of highest rounded cosine}."""
    ids, vectors = zip(*sorted(records.items()), strict=True)
    m = np.array(vectors, dtype=float)
    size = np.linalg.norm(m, axis=1)
    out = {}
    for i, v in queries.items():
        v = np.array(v, dtype=float)
        n = size * np.linalg.norm(v)
        cosine = np.round(np.divide(m @ v, n, out=np.zeros(len(m)), where=n > 0), 6)
        out[i] = [ids[j] for j in np.argsort(-cosine, kind="stable") if ids[j] != i][:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.query_id, []).append(r.record_id)
    return out


def test_registered_search_finds_the_true_neighbours(spark, sf_dir):
    q, r = retrieval_queries.vectors(spark, sf_dir)
    want = brute({x.query_id: x.vector for x in q.collect()}, {x.record_id: x.vector for x in r.collect()}, 5)
    got = found(registry.QUERIES["q_dense_exact_topk"](spark, sf_dir))
    assert got.keys() == want.keys()
    assert sum(len(set(got[i]) & set(want[i])) for i in want) >= 0.99 * sum(map(len, want.values()))


@pytest.mark.parametrize("rows", [3, 1000])
def test_blocks_do_not_change_the_result(spark, rows):
    rng = np.random.default_rng(1)
    vectors = {i: [float(x) for x in rng.integers(-2, 3, 4)] for i in range(60)} | {i: [1.0, 2.0, 0.0, 1.0] for i in range(60, 80)} | {80: [0.0] * 4}
    r = spark.createDataFrame([*vectors.items(), (81, None)], "record_id long, vector array<float>")
    q = r.where("record_id % 5 = 0").withColumnRenamed("record_id", "query_id")
    got = found(R.dense_top_k(q, r, 4, query_rows=rows, record_rows=rows))
    assert got == brute({i: v for i, v in vectors.items() if i % 5 == 0}, vectors, 4)
    assert R.dense_top_k(q, r.where("false"), 4).count() == 0


def test_candidates_unite_dense_terms_and_addresses(spark):
    near = [(i, "src", "en", ["common"], [1.0, 0.01 * i]) for i in range(1, 5)]
    far = [(5, "src", "en", ["common", "x17"], [-1.0, 0.0]), (6, "Unit-42", "en", ["other"], [-1.0, 0.1]), (7, "abc", "none", ["other"], [-1.0, 0.2]), (8, "src", "Deep Blue", ["other"], [-1.0, 0.3])]
    r = spark.createDataFrame(near + far, "record_id long, entity string, attribute string, tokens array<string>, vector array<float>")
    q = spark.createDataFrame([(1, "ask unit-42 abc of deep blue", ["x17", "ask"], [1.0, 0.0])], "query_id long, query string, tokens array<string>, vector array<float>")
    assert {x.record_id for x in R.rerank_candidates(q, r, 2).collect()} == {2, 3, 5, 6, 8}


def test_registered_rerank_matches_brute_force(spark, sf_dir):
    q, r = retrieval_queries.vectors(spark, sf_dir)
    asked, d = {x.query_id for x in q.collect()}, read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", T.terms(F.col("text")).alias("terms"))
    d = {x.doc_id: x for x in d.collect()}
    v = {x.record_id: x.vector for x in r.collect() if x.record_id in d}
    ids = sorted(v)
    m = np.array([v[i] for i in ids], dtype=float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    post = Counter(t for i in ids for t in set(d[i].terms))
    named = {f: Counter(d[i][f].strip().lower() for i in ids) for f in ("source", "lang")}
    got = found(registry.QUERIES["q_dense_rerank_united"](spark, sf_dir))
    assert got.keys() == asked & v.keys()
    for i in got:
        text, own, rows = f"{d[i].source} {d[i].text}".lower(), set(d[i].terms), []
        cosine = m @ m[ids.index(i)]
        dense = {ids[j] for j in [j for j in np.argsort(-cosine, kind="stable") if ids[j] != i][:32]}
        for j, x in enumerate(ids):
            shared, names = own & set(d[x].terms), {f: d[x][f].strip().lower() for f in named}
            address = any(len(n) >= 4 and n in text and named[f][n] <= 512 for f, n in names.items())
            if x != i and (x in dense or address or any(post[t] <= 256 for t in shared)):
                lexical = len(shared) / max(1, len(own) * len(set(d[x].terms))) ** 0.5
                score = 0.35 * (cosine[j] + 1) / 2 + 0.15 * lexical + 0.3 * (names["source"] != "" and names["source"] in text) + 0.2 * (names["lang"] != "" and names["lang"] in text)
                rows.append((-round(score, 6), x))
        assert got[i] == [x for _, x in sorted(rows)[:3]]


@pytest.mark.parametrize("rows", [3, 1_000])
def test_reranked_cells_equal_joined_pairs(spark, rows):
    """Pairs reach the cells as ids; missing texts and vectors, vectors of other sizes and repeated ids score as in a join."""
    rng = np.random.default_rng(5)
    words = lambda: None if rng.random() < 0.1 else [f"w{x}" for x in rng.choice(30, rng.integers(0, 12), replace=False)]
    vector = lambda: None if rng.random() < 0.1 else [0.0, 0.0] if rng.random() < 0.1 else [float(x) for x in rng.normal(size=3 if rng.random() < 0.1 else 2)]
    name = lambda: [None, "", " Web ", "En", "fr"][rng.integers(5)]
    r = spark.createDataFrame([(i % 37, name(), name(), words(), vector()) for i in range(40)], "record_id long, entity string, attribute string, tokens array<string>, vector array<float>")
    q = spark.createDataFrame([(i % 9, [None, "all the WEB", "en fr"][i % 3], words(), vector()) for i in range(10)], "query_id long, query string, tokens array<string>, vector array<float>")
    pairs = spark.createDataFrame([(i, j) for i in range(9) for j in range(40) if rng.random() < 0.6], "query_id long, record_id long")
    joined = pairs.join(q.toDF("query_id", "query", "q_terms", "q_vector"), "query_id").join(r.toDF("record_id", "entity", "attribute", "r_terms", "r_vector"), "record_id")
    joined = joined.withColumn("cosine", V.cosine(F.col("q_vector"), F.col("r_vector")))
    want = R.top_k(R.dense_rerank(joined).select("query_id", "record_id", F.round("score", 6).alias("score")), 20)
    got = R.dense_rerank_top_k(q, r, pairs, 20, query_rows=rows, record_rows=rows)
    key = lambda df: sorted(((x.query_id, x["rank"], x.record_id, x.score) for x in df.collect()), key=repr)
    assert key(got) == key(want)
    assert R.dense_rerank_top_k(q, r, pairs.where("false"), 3).count() == 0 and R.dense_rerank_top_k(q, r.where("false"), pairs, 3).count() == 0


def test_registered_rerank_sends_no_vectors_with_pairs(spark, sf_dir):
    plan = registry.QUERIES["q_dense_rerank_united"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join " in x]
    assert "FlatMapCoGroupsInArrow" in plan and joins and not [x for x in joins if "vector" in x] and "q_vector" not in plan


@pytest.mark.parametrize("by", [(), ("g",)])
def test_contained_equals_all_pairs(spark, by):
    """Needles of one character and more, many with one prefix, some that hold in every text."""
    rng = random.Random(6)
    say = lambda k: "".join(rng.choice("abcé ") for _ in range(k))
    texts = [(rng.randrange(2), i, rng.choice([None, "", say(3), "commonprefix " + say(40)])) for i in range(60)]
    needles = [(rng.randrange(2), 100 + i, rng.choice([None, "", say(1), say(2), say(3), say(4), "commonprefix " + say(rng.randrange(4)), "common", say(6)])) for i in range(120)]
    t = spark.createDataFrame(texts, "g int, text_id long, text string").select(*by, "text_id", "text")
    n = spark.createDataFrame(needles, "g int, needle_id long, needle string").select(*by, "needle_id", "needle")
    want = sorted((a, b) for g, a, text in texts for h, b, needle in needles if text is not None and needle and needle in text and (not by or g == h))
    got = R.contained(t, n, by)
    assert got.columns == [*by, "text_id", "needle_id"] and sorted((r["text_id"], r["needle_id"]) for r in got.collect()) == want and want
    assert R.contained(t, n.where("false"), by).collect() == []


def test_contained_equals_contains_on_given_tables(spark, sf_dir):
    """The words of documents' names against all benchmark items."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("needle_id"), F.lower(F.substring_index(F.trim("text"), " ", 1)).alias("needle"))
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("text_id"), F.lower("text").alias("text"))
    want = {(r["text_id"], n["needle_id"]) for r in b.collect() for n in d.collect() if n["needle"] and n["needle"] in r["text"]}
    assert {tuple(r) for r in R.contained(b, d).collect()} == want and want


def test_small_groups_make_no_grams_and_large_ones_do(spark, monkeypatch):
    """Groups of few needles are compared directly; where one has more, it alone is anchored, with the same rows."""
    rng = random.Random(5)
    text = [(g, i, "".join(rng.choice("abcd ") for _ in range(40))) for g in range(4) for i in range(30 if g == 3 else 5)]
    needle = [(g, i, x[j : j + 1 + i % 6]) for g, i, x in text for j in (3,)]
    t, n = spark.createDataFrame(text, "g int, text_id int, text string"), spark.createDataFrame(needle, "g int, needle_id int, needle string")
    want = sorted((g, i, k) for g, i, x in text for h, k, y in needle if g == h and y in x)
    assert sorted(map(tuple, R.contained(t, n, ["g"], few=8).collect())) == want
    made = []
    monkeypatch.setattr(R, "_with_grams", lambda *a: made.append(a))
    assert sorted(map(tuple, R.contained(t, n, ["g"]).collect())) == want and not made


def test_signature_blocks_equal_pairs(spark):
    """Blocks of a few rows of a code give the rows of comparing all pairs of near codes; null vectors don't count."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in np.float32(rng.normal(0, 1, 64) + (2 if i % 3 else 0))]) for i in range(200)] + [(500, None)]
    r = spark.createDataFrame(rows, "record_id long, vector array<float>")
    q = r.where("record_id % 20 = 0").withColumnRenamed("record_id", "query_id")
    pairs = R.dense_scores(q, r.where("vector is not null")).where("query_id <> record_id and query_id <> 500").select("query_id", "record_id", F.round("cosine", 6).alias("score"))
    want = sorted(map(tuple, R.top_k(pairs, 5).select("query_id", "record_id", "rank").collect()))
    got = R.signature_top_k(q, r, 5, query_rows=3, record_rows=7).select("query_id", "record_id", "rank").collect()
    assert sorted(map(tuple, got)) == want and want
    text = R.signature_top_k(q, r, 5)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in text


@pytest.mark.parametrize("rows", [2, 1_000])
def test_pair_blocks_equal_scored_pairs(spark, rows):
    """Blocks of a label score as joined pairs do; null vectors score null, null labels pair with nothing."""
    rng = np.random.default_rng(3)
    net = N.PairMlp(((rng.normal(size=(12, 4)), rng.normal(size=4)), (rng.normal(size=(4, 1)), np.ones(1))))
    r = spark.createDataFrame([(i, None if i % 9 == 4 else [float(x) for x in rng.normal(size=3)], [None, 0, 1, 1][i % 4]) for i in range(40)], "record_id int, vector array<float>, label int")
    q = r.where("record_id % 3 = 0").withColumnRenamed("record_id", "query_id")
    pairs = q.toDF("query_id", "a", "label").join(r.toDF("record_id", "b", "label"), "label")
    want = pairs.select("query_id", "record_id", F.round(N.scorer(net)("a", "b"), 6).alias("score"))
    got = N.block_scores(q, r, "label", net.block, rows, rows).withColumn("score", F.round("score", 6))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr) and got.dtypes == want.dtypes


def pools_by_hand(queries, records):
    """BM25 in each pool; equal (id, number of words) of a pool are one record, as in SQL."""
    size, asked, tf = defaultdict(list), Counter(), Counter()
    for i, p, words in records:
        size[p].append(len(words) if words is not None else None)
        tf.update((i, p, len(words), w) for w in words or [] if w is not None)
    asked.update((q, p, w) for q, p, words in queries for w in words or [] if w is not None)
    df = Counter((p, w) for _, p, _, w in tf)
    out = defaultdict(float)
    for (q, p, w), times in asked.items():
        for (i, rp, n_words, rw), f in tf.items():
            if (rp, rw) == (p, w) and p is not None:
                n, mean = len(size[p]), statistics.mean(x for x in size[p] if x is not None)
                out[q, i] += times * math.log(1 + (n - df[p, w] + 0.5) / (df[p, w] + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * n_words / mean))
    return {k: round(v, 6) for k, v in out.items()}


@pytest.mark.parametrize("words,tasks", [(2, 3), (1_024, 20_000)])
def test_bm25_of_pools_is_that_of_all_words(spark, monkeypatch, words, tasks):
    """Pools without queries or records, a hot one, repeated ids, several queries of a pool, nulls."""
    monkeypatch.setattr(R, "ASKED_WORDS", words)
    monkeypatch.setattr(R, "HIT_RECORDS", tasks)
    rng = random.Random(5)
    say = lambda most: [f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(most))]
    records = [(i, rng.choice([1, 1, 1, 2, 3, 4]), say(15)) for i in range(150)] + [(7, 1, ["w1", "w2", None]), (7, 1, ["w1", "w1", "w9"]), (8, 2, None), (9, 1, []), (10, None, ["w1"]), (11, 6, ["w1"])]
    queries = [(q, p, say(12)) for q, p in enumerate([1, 1, 2, 3, 5])] + [(0, 1, ["w1", "w1", "w3"]), (0, 2, ["w2", None]), (8, 4, None), (9, None, ["w1"])]
    q, r = spark.createDataFrame(queries, "query_id long, pool long, words array<string>"), spark.createDataFrame(records, "record_id long, pool long, words array<string>").repartition(3)
    got = R.bm25(q, r, pool="pool").collect()
    assert len(got) > 100 and {(x["query_id"], x["record_id"]): round(x["score"], 6) for x in got} == pytest.approx(pools_by_hand(queries, records), abs=2e-6)


def records_shuffled(node):
    """Rows that a plan's exchanges wrote."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
        return records_shuffled(node.executedPlan() if kind == "AdaptiveSparkPlanExec" else node.plan())
    own = node.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(records_shuffled(node.children().apply(i)) for i in range(node.children().size()))


def test_bm25_of_pools_shuffles_only_shared_words(spark):
    """Words that no query of their pool has never become rows of their own."""
    r = spark.range(200).select(F.col("id").alias("record_id"), (F.col("id") % 10).alias("pool"), F.concat(F.array(F.lit("both")), F.transform(F.sequence(F.lit(1), F.lit(500)), lambda i: F.concat(F.lit("own"), i.cast("string")))).alias("words"))
    q = spark.range(10).select(F.col("id").alias("query_id"), F.col("id").alias("pool"), F.array(F.lit("both"), F.lit("none")).alias("words"))
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for large tables
    try:
        df = R.bm25(q, r, pool="pool")
        assert len(df.collect()) == 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    written = records_shuffled(df._jdf.queryExecution().executedPlan())
    assert 400 <= written < 2_000  # 200 records of 501 words
