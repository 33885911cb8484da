"""Registered dataset queries take their whole tables."""

from pyspark.sql import functions as F

from palimpsest.operators import datasets as D
from palimpsest.plans import registry
from palimpsest.sources.files import read_table


def test_every_document_has_hard_negatives(spark, sf_dir):
    d = {r.doc_id: (r.source, r.lang) for r in read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang").collect()}
    rows = registry.QUERIES["q_hard_negatives"](spark, sf_dir).collect()
    assert {r.episode_id for r in rows} == {10 * i for i in d}
    assert len({(r.episode_id, r.item_id) for r in rows}) == len(rows) == 8 * len(d)
    assert not any(d[r.item_id] == d[r.episode_id // 10] for r in rows)


def test_a_group_of_one_attribute_does_not_use_up_the_quota(spark):
    """Group 1 has 200 items of the episode's attribute and five others; the five fill the quota of the group."""
    items = [(i, 1, "a") for i in range(200)] + [(300 + i, 1, "b") for i in range(5)] + [(400 + i, 2 + i % 9, "abc"[i % 3]) for i in range(90)]
    i = spark.createDataFrame(items, "item_id long, group_id long, attribute string")
    e = spark.createDataFrame([(x, x, 1, "a") for x in range(40)], "episode_id long, item_id long, group_id long, attribute string")
    rows = D.hard_negatives(e, i, k=8).collect()
    own = {x: (g, a) for x, g, a in items}
    for x in range(40):
        mine = [r for r in rows if r["episode_id"] == x]
        assert len(mine) == 8 == len({r["item_id"] for r in mine}) and sum(r["pool"] == 0 for r in mine) >= 2
        assert all(own[r["item_id"]] != (1, "a") for r in mine)


def test_candidates_of_an_episode_are_not_shuffled(spark):
    """About 300 candidates of each episode stay in its row: no exchange by episode, and 8 rows of each come out."""
    items = spark.range(400).selectExpr("id AS item_id", "concat('g', id % 7) AS group_id", "concat('a', id % 5) AS attribute")
    e = items.withColumn("episode_id", F.col("item_id") * 10)
    out = D.hard_negatives(e, items, 8)
    assert "hashpartitioning(episode_id" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    places = {}
    for r in rows:
        places.setdefault(r["episode_id"], []).append((r["place"], r["item_id"]))
    assert len(places) == 400 and all(sorted(p for p, _ in own) == list(range(1, 9)) and len({i for _, i in own}) == 8 for own in places.values())
    assert all(r["episode_id"] // 10 != r["item_id"] and r["item_id"] % 35 != r["episode_id"] // 10 % 35 for r in rows)
