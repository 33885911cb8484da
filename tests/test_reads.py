"""The whole read on rows small enough to tell by hand."""

from palimpsest.operators import datasets as D
from palimpsest.operators import reads as RD

RECORDS = "record_id long, page_id long, entity string, attribute string, value string, tokens array<string>, vector array<double>, confidence double, importance double"
PAGES = "page_id long, vector array<double>, tier string, importance double, age_hours double"
QUERIES = "query_id long, query string, tokens array<string>, vector array<double>"


def _tables(spark):
    r = [(i, i // 2, "", "", "", [f"w{i}"] if i == 7 else ["aa"], [1.0, float(i)], 0.0, 0.0) for i in range(8)]
    r[5] = (5, 2, "projectzeta", "owner", "mira", ["projectzeta"], [0.0, 1.0], 0.0, 0.0)
    pages = [(p, [1.0, 2.0 * p], "cold", 0.0, 1.0) for p in range(4)]
    q = [(1, "who is owner of projectzeta", ["owner", "projectzeta"], [1.0, 0.0]), (2, "nothing known", ["nothing"], [1.0, 0.0])]
    return spark.createDataFrame(q, QUERIES), spark.createDataFrame(r, RECORDS), spark.createDataFrame(pages, PAGES), spark.createDataFrame([(0, 4), (1, 6)], "record_id long, related_id long")


def test_read_takes_names_first_then_pages_and_links(spark):
    q, r, p, e = _tables(spark)
    rows = RD.read(q, r, p, e, k=3, most_pages=1, dims=2).collect()
    named = [x for x in rows if x.query_id == 1]
    assert [(x.record_id, x.path, x.rank) for x in named] == [(5, "direct", 1)] and named[0].score > 10
    # query 2 has no name: page 0 (its vector is the query's), then page 2, to which record 0 links
    other = {(x.record_id, x.hop) for x in rows if x.query_id == 2}
    assert {(0, 0), (1, 0)} <= other and len(other) == 3 and {i // 2 for i, h in other if h == 1} == {2}


def test_candidate_pages(spark):
    q, r, p, _ = _tables(spark)
    assert RD.candidate_pages(q, r, p, few=4, dims=2).count() == 8
    assert RD.candidate_pages(q, r, p.limit(0), few=4, dims=2).count() == 0
    some = {(x.query_id, x.page_id) for x in RD.candidate_pages(q, r, p, few=1, near=1, dims=2).collect()}
    assert (1, 2) in some and {a for a, _ in some} == {1, 2}


def test_mined_pairs_are_one_to_one(spark):
    facts = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(60)], "fact_id long, attribute string")
    asked = spark.createDataFrame([(a, f"{a}{n}") for a in "abc" for n in range(2)], "attribute string, query string")
    rows = D.mined_pairs(facts, asked, ["joke"]).collect()
    own = {i: "abc"[i % 3] for i in range(60)}
    assert sorted((x.fact_id, x.label) for x in rows) == sorted((i, n) for i in range(60) for n in (0, 1))
    assert all((x.asked == own[x.fact_id]) == (x.label == 1) for x in rows)
    assert all((x.query == "joke") if x.asked is None else x.query[0] == x.asked for x in rows) and any(x.asked is None for x in rows)
    alone = D.mined_pairs(facts.where("attribute = 'a'"), asked.where("attribute = 'a'"), []).collect()
    assert {x.label for x in alone} == {1} and len(alone) == 20
