"""Classifiers, the mix, shards and the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import features, mixing, quality_model, sharding, toxicity


def toxic_corpus(n=400):
    rng = random.Random(3)
    plain = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(30)]
        label = int(i % 4 == 0)
        if label:
            w[rng.randrange(30)] = rng.choice(["vile", "rotten"])
        # the label goes with a group's name in this sample: what the penalty must undo
        if rng.random() < (0.8 if label else 0.05):
            w[rng.randrange(30)] = "muslim"
        rows.append((i, " ".join(w), label, None))
    return rows


@pytest.fixture(scope="module")
def labelled(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t, None) for i, t, _, _ in rows] + [(900, None, None), (901, "", None)], "doc_id long, text string, _label int")
    labels = spark.createDataFrame([(i, y, y) for i, _, y, _ in rows] + [(5, None, None), (None, 1, 1), (7777, 1, 1)], "doc_id long, toxic int, quality int")
    return docs, labels


def test_swaps():
    pairs = toxicity.swapper(most=1)
    assert pairs("Hello. A woman said so. Bye!") == [(" A woman said so.", " A man said so.")]
    assert pairs("nothing here") == [] == pairs("") and toxicity.swapper(())("a woman") == []
    assert [b for _, b in toxicity.swapper()("Die Frau kam")] == ["Die mann kam"]
    assert toxicity.swapper((("orcs", "elves"),))("The ORCS came") == [("The ORCS came", "The elves came")]
    long = "Filler words come here. " * 5000 + "An old tale."
    assert toxicity.swapper()(long) == [(" An old tale.", " An young tale.")]


def margin_by_hand(model, text):
    """The model's margin from words and beginnings, one by one."""
    row = np.unique(features.of_text(text, features.word_features))
    return sum(model.weights[b] for b in row.tolist()) + model.bias


def test_toxicity_scores_are_those_of_the_model(spark, labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels, "doc_id", "text", "toxic", lambda key: F.lit(True))
    assert model.n_rows == 400 and model.n_pairs > 50
    again = toxicity.train(docs.repartition(7), labels, "doc_id", "text", "toxic", lambda key: F.lit(True))
    assert np.array_equal(model.weights, again.weights) and model.bias == again.bias
    text = {r.doc_id: r.text for r in docs.collect()}
    twice = docs.union(docs.where("doc_id < 3"))
    rows = toxicity.scored(twice.withColumnsRenamed({"_label": "margin"}), model, "doc_id", "text", 0.7).collect()
    assert len(rows) == len(text) + 3
    for r in rows:
        assert r.score == pytest.approx(1 / (1 + np.exp(-margin_by_hand(model, text[r.id] or ""))), abs=1e-5)


def test_pairs_are_bounded_by_their_parameter_only(labelled):
    docs, labels = labelled
    args = (docs, labels, "doc_id", "text", "toxic", lambda key: F.lit(True))
    assert toxicity.train(*args, most_pairs=7).n_pairs == 7 and toxicity.train(*args, terms=()).n_pairs == 0


def test_penalty_frees_neutral_mentions(labelled):
    docs, labels = labelled
    trains = lambda key: F.lit(True)
    args = (docs, labels, "doc_id", "text", "toxic", trains)
    free, held = toxicity.train(*args, strength=0.0), toxicity.train(*args, strength=20.0)
    gap = lambda m: abs(toxicity.margin_of(m, "word1 word2 muslim word3") - toxicity.margin_of(m, "word1 word2 christian word3"))
    assert held.n_pairs > 50 and gap(held) < 0.2 * gap(free)
    assert toxicity.margin_of(held, "word1 vile word3") > toxicity.margin_of(held, "word1 word2 word3") + 1


def test_scores_cover_every_row(labelled, nothing):
    docs, labels = labelled
    out = toxicity.score(docs, labels, trains=lambda key: F.crc32(F.encode(key, "UTF-8")) % 3 != 1)
    rows = {r.id: r for r in out.collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    right = np.mean([(rows[i].score > 0.5) == (i % 4 == 0) for i in held])
    assert right > 0.95 and rows[900].score == rows[901].score
    none = toxicity.score(docs, labels.where("false"))
    assert {r.score for r in none.collect()} == {0.5}
    assert toxicity.score(nothing, labels).count() == 0


def test_quality_scores(spark, labelled, nothing):
    rng = random.Random(5)
    texts = []
    for i in range(300):
        w = [f"w{rng.randrange(50)}" for _ in range(40)]
        bad = i % 5 == 0
        texts.append((i, " ".join(x + "###" if bad else x for x in w), int(not bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts] + [(1000, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, quality int")
    trains = lambda key: F.crc32(F.encode(key, "UTF-8")) % 5 != 0
    rows = {r.id: r for r in quality_model.score(docs, labels, trains=trains).collect()}
    held = [i for i, _, _ in texts if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 30 and all(rows[i].predicted == texts[i][2] for i in held) and 0 <= rows[1000].score <= 1
    model = quality_model.train(docs, labels, "doc_id", "text", "quality", trains)
    assert model.n_rows == 300 - len(held)
    for i, t, _ in texts[:40]:
        used = model.weights[features.of_text(t, features.shape_features)]
        used = used[used != 0]
        margin = used.sum() / max(1.0, np.sqrt(len(used))) + model.bias
        assert rows[i].score == pytest.approx(1 / (1 + np.exp(-(model.slope * margin + model.shift))), abs=1e-4)
    clash = docs.withColumns({"margin": F.lit(1), "_text": F.lit("x"), "id": F.lit(0)}).union(docs.withColumns({"margin": F.lit(1), "_text": F.lit("x"), "id": F.lit(0)}).where("doc_id < 9"))
    kept = quality_model.keep(clash, model, "text", 0.3)
    good = {i for i, r in rows.items() if r.predicted}
    assert kept.columns == clash.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i in [*rows, *range(9)] if i in good)
    one = quality_model.score(docs, labels.where("quality = 1"))
    assert one.agg(F.countDistinct("score")).first()[0] == 1
    assert quality_model.score(nothing, labels).count() == 0


def test_dual_descent_separates():
    rows = [np.array([0]), np.array([1]), np.array([0, 2]), np.array([1, 2])]
    w, b = quality_model.dual_descent(np.array([0, 1, 2, 4, 6]), np.concatenate(rows), np.ones(6), np.array([1.0, -1.0, 1.0, -1.0]), 3, np.full(4, 10.0))
    assert [np.sign(w[r].sum() + b) for r in rows] == [1, -1, 1, -1]


def water_fill(sizes, weights, passes):
    capped = set()
    while True:
        left = sum(sizes.values()) - sum(passes * sizes[s] for s in capped)
        share = sum(weights[s] for s in sizes if s not in capped)
        new = {s for s in sizes if s not in capped and share and weights[s] * left / share > passes * sizes[s]}
        if not new:
            return {s: float(passes * sizes[s]) if s in capped else weights[s] * left / share for s in sizes}
        capped |= new


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 20, "d": 5, None: 300}, {"a": 5, "b": 5}, {"a": 0, "b": 7}, {"z": 100}])
def test_targets(spark, sizes):
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(water_fill(sizes, weights, 3))


def test_mix(spark, docs, texts, nothing):
    first, again = (mixing.mix(d, parts=p).collect() for d, p in ((docs, 8), (docs.repartition(2), 8)))
    assert first == again and len(first) == len(texts)
    words = lambda t: len((t or "").replace("\x0b", " ").split())
    by = {}
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    for r in first:
        assert r.size == words(texts[r.id]) and 0 <= r.taken <= 3 * r.size and (r.position is None) == (r.copies == 0)
        by.setdefault(source[r.id], [r.target, 0, r.source_size])[1] += r.taken
    assert all(taken == int(target) and target <= 3 * size for target, taken, size in by.values())
    assert abs(sum(t for t, _, _ in by.values()) - sum(map(words, texts))) < 1e-6
    places = [r.position for r in first if r.position is not None]
    assert places == sorted(places) and 0 <= places[0] and places[-1] <= 1
    out = mixing.mixed_documents(docs, parts=8)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in first)
    check_order(docs, first, [r.doc_id for r in out.collect()])
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


def check_order(docs, planned, order):
    """Every copy stands where the inverse of its source's demand puts it."""
    plan = {r.id: r for r in planned}
    place = {}
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    names = sorted({s for s in source.values() if s is not None}) + [None] * (None in source.values())
    tilt = {s: mixing.TILTS[i % 3] for i, s in enumerate(names)}
    for i, r in plan.items():
        if r.copies:
            k = tilt[source[i]]
            # the first copy's position gives the words before it: the integral of the weight
            words = r.target * (r.position + k * (r.position**2 - r.position))
            for n in range(r.copies):
                low, high, want = 0.0, 1.0, (words + n * r.source_size) / r.target
                for _ in range(60):
                    mid = (low + high) / 2
                    low, high = (mid, high) if mid + k * (mid**2 - mid) < want else (low, mid)
                place.setdefault(i, []).append(low)
    seen, last = Counter(), 0.0
    for i in order:
        at = place[i][seen[i]]
        seen[i] += 1
        assert at >= last - 1e-7
        last = at
    assert seen == {i: len(x) for i, x in place.items()}


def test_mix_keeps_every_row(spark):
    """Null and repeated ids, clashing names, a capped source and one that comes in part."""
    rows = [(None, "a b c", "s1", 1, 2, "x"), (None, "d e", "s1", 1, 2, "x"), (7, "f g", "s1", 3, 4, "y"), (7, "f g", "s1", 3, 4, "y"), (7, "h", "s1", 3, 4, "y"), (8, None, "s1", 0, 0, "z")]
    rows += [(100 + i, " ".join(f"w{j}" for j in range(40)), "s2", 5, 6, "v") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int, position int, row string")
    plan = mixing.mix(docs, parts=4).collect()
    assert len(plan) == len(rows)
    out = mixing.mixed_documents(docs, parts=4)
    assert out.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    small = {k: v for k, v in got.items() if k[0] is None or k[0] < 100}
    assert small == {(None, "a b c"): 3, (None, "d e"): 3, (7, "f g"): 6, (7, "h"): 3}
    assert sum(got.values()) == sum(r.copies for r in plan)


def test_positions_invert_demand(spark):
    df = spark.createDataFrame([(t / 10, k) for t in range(11) for k in (-0.5, 0.0, 0.5)], "t double, k double")
    words = 40.0 * (F.col("t") + F.col("k") * (F.col("t") * F.col("t") - F.col("t")))
    assert df.select(F.max(F.abs(mixing.position(words, F.lit(40.0), F.col("k")) - F.col("t")))).first()[0] < 1e-9


def best_capacity(sizes, n):
    best = {0: [0] * (len(sizes) + 1)}
    sums = np.concatenate([[0], np.cumsum(sizes)])
    cost = [float("inf")] * (len(sizes) + 1)
    cost[0] = 0
    for _ in range(n):
        new = [0] + [min(max(cost[j], sums[i] - sums[j]) for j in range(i + 1)) for i in range(1, len(sizes) + 1)]
        cost = new
    return cost[-1] if best else None


def test_minimax_cuts_are_the_best():
    rng = random.Random(2)
    for _ in range(40):
        sizes = [rng.randrange(1, 50) for _ in range(rng.randrange(1, 20))]
        n = rng.randrange(1, 6)
        ends = sharding.minimax_cuts(sizes, n)
        parts = [sum(sizes[a:b]) for a, b in zip([0, *ends], ends)]
        assert ends[-1] == len(sizes) and len(ends) <= n and max(parts) == best_capacity(sizes, n)
    assert sharding.minimax_cuts([], 4) == []


def test_shards(docs, texts, nothing):
    rows = sharding.shard(docs, n_shards=4, salts=2).collect()
    assert len(rows) == len(texts)
    home, slots = {}, {}
    for r in rows:
        data = (texts[r.id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        assert home.setdefault(data, r.shard) == r.shard
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(4))
    assert sharding.shard(nothing).count() == 0


@pytest.mark.parametrize(("units", "n_shards"), [(2, 5), (4, 3), (1 << 16, 4), (4, 1)])
def test_shards_are_the_best_over_text_groups(spark, units, n_shards):
    rng = random.Random(units)
    rows = [(i if i % 7 else None, f"{rng.randrange(40)} " * rng.randrange(1, 30)) for i in range(300)] + [(900, "big " * 3000)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = docs.groupBy("text").agg(F.sum(F.length("text") + 1).alias("size")).orderBy(F.xxhash64("text")).collect()
    got = docs.sparkSession.createDataFrame(sharding.shard(docs, n_shards=n_shards, units=units, salts=2).collect(), "id long, size long, text_crc32 long, shard int, slot long")
    sums = got.groupBy("shard").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last")).collect()
    assert max(r["size"] for r in sums) == best_capacity([r["size"] for r in order], n_shards)
    assert all(r["n"] == r["slots"] == r["last"] + 1 for r in sums) and got.groupBy("text_crc32").agg(F.countDistinct("shard").alias("k")).where("k > 1").count() == 0


def test_features_of_long_and_empty_texts():
    assert len(features.of_text("", features.word_features)) == 0 == len(features.of_text(" \n", features.shape_features))
    assert len(features.of_text("word " * 200_000, features.shape_features)) > 0


def test_pipeline_stages(spark, docs, texts, tmp_path):
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
    d = str(tmp_path)
    spark.createDataFrame([(i, int(bool(t) and len(t) > 100 and "same line" not in t)) for i, t in enumerate(texts)], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    item = next(t for t in texts if t and 300 < len(t) < 2000 and "Sigma" in t)
    spark.createDataFrame([(1, " ".join(item.split()[2:30]))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    rows.write.parquet(f"{d}/documents.parquet")
    out = rows
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, out, d)
        out.write.parquet(f"{d}/stage{i}.parquet")
        out = spark.read.parquet(f"{d}/stage{i}.parquet")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == rows.columns
    assert out.count() and {"doc_id", "shard", "slot"} <= set(out.columns)
    kept = {r.doc_id for r in spark.read.parquet(f"{d}/stage2.parquet").collect()}
    assert kept and not any(" ".join(item.split()[2:30]) in (texts[i] or "") for i in kept)
    key = ("doc_id", "shard", "slot")
    assert sorted(map(tuple, corpus_pipeline.run(spark, d).select(*key).collect())) == sorted(map(tuple, out.select(*key).collect()))


def test_pipeline_of_nothing(spark, docs, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs.where("false").write.parquet(f"{d}/documents.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0


def test_noise_and_few_labels_crash_nothing(spark):
    """Random labels, one label for each class, and one class only: scores and kept rows by one rule."""
    rng = random.Random(1)
    say = lambda: " ".join(rng.choice(["red", "Blue", "green,", "dark.", "42"]) for _ in range(30))
    docs = spark.createDataFrame([(i, say(), "en", "s", 100) for i in range(120)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(2)
    keys = [i for i in range(120) if zlib.crc32(str(i).encode()) % 5]
    cases = [[(i, rng.randrange(2)) for i in keys] for _ in range(3)] + [[(keys[0], 0), (keys[1], 1)], [(keys[0], 1)], [(keys[0], 0)], []]
    for labelled in cases:
        labels = spark.createDataFrame(labelled, "doc_id long, quality int")
        model = quality_model.train(docs, labels, "doc_id", "text", "quality", lambda key: F.crc32(F.encode(key, "UTF-8")) % 5 != 0)
        assert model.slope >= 0
        good = {r["id"] for r in quality_model.scored(docs, model, "doc_id", "text", 0.3).where("predicted = 1").collect()}
        assert {r["doc_id"] for r in quality_model.keep(docs, model, "text", 0.3).collect()} == good
        if model.slope == 0:
            assert len(good) in (0, 120)
    assert corpus_pipeline.LEAST_QUALITY == 0.3


def test_a_fit_that_ranks_wrongly_gives_the_share_of_ones():
    rng = np.random.default_rng(0)
    flat = 0
    for _ in range(20):
        rows = [(int(rng.integers(2)), np.unique(rng.integers(0, 200, 30))) for _ in range(60)]
        model = quality_model.fit(rows)
        assert model.slope >= 0
        if model.slope == 0:
            flat += 1
            ones = sum(y for y, _ in rows)
            assert 1 / (1 + np.exp(-model.shift)) == pytest.approx((ones + 1) / (len(rows) + 2))
    assert flat
