"""Placement against the same rounds in plain Python, and what a consolidation has to keep."""

import numpy as np
import pytest

from palimpsest.operators import placement as P


def cosine(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return round(float(np.dot(a, b) / n), 6) if n else 0.0


def by_hand(records, pages):
    room, placed = {p: r for p, _, r in pages}, {}
    vectors = {p: v for p, v, _ in pages}
    while len(placed) < len(records) and any(r > 0 for r in room.values()):
        offers = {}
        for i, v in records:
            if i not in placed:
                best = min((-cosine(v, vectors[p]), p) for p in vectors if room[p] > 0)
                offers.setdefault(best[1], []).append((best[0], i))
        for p, own in offers.items():
            for s, i in sorted(own)[: room[p]]:
                placed[i] = p
            room[p] -= min(room[p], len(own))
    return placed


def made(seed, n, m, room):
    rng = np.random.default_rng(seed)
    records = [(i, rng.normal(0, 1, 64) + (3 if i % 3 == 0 else 0)) for i in range(n)]  # a third wants the same pages
    return records, [(1000 + p, rng.normal(0, 1, 64) + (2 if p == 0 else 0), room) for p in range(m)]


def frames(spark, records, pages):
    return (spark.createDataFrame([(i, v.tolist()) for i, v in records], "record_id long, vector array<double>").repartition(3),
            spark.createDataFrame([(p, v.tolist(), r) for p, v, r in pages], "page_id long, vector array<double>, room int"))


@pytest.mark.parametrize("seed,room,choices", [(1, 8, 64), (2, 6, 64), (3, 4, 64)])
def test_placement_follows_the_rounds(spark, seed, room, choices):
    """Room for all, for just all, and for two thirds."""
    records, pages = made(seed, 60, 10, room)
    got = {r["record_id"]: r["page_id"] for r in P.place(*frames(spark, records, pages), choices, target=1.0).collect()}
    assert got == by_hand(records, pages)


def test_few_choices_place_all_and_cost_less_than_a_hash(spark):
    records, pages = made(5, 120, 16, 9)
    rows = P.place(*frames(spark, records, pages), 3, target=1.0).collect()
    load = {p: sum(r["page_id"] == p for r in rows) for p, _, _ in pages}
    assert len(rows) == 120 == len({r["record_id"] for r in rows}) and max(load.values()) <= 9
    vectors, own = {p: v for p, v, _ in pages}, dict(records)
    hashed = np.mean([cosine(own[i], vectors[1000 + i % 16]) for i in own])
    assert np.mean([r["score"] for r in rows]) > hashed + 0.05


def test_nothing_to_place(spark):
    r, p = frames(spark, *made(6, 5, 2, 3))
    assert P.place(r.where("false"), p).collect() == [] and P.place(r, p.where("false")).collect() == []


def test_consolidation_reaches_its_target(spark):
    rng = np.random.default_rng(8)
    rows = [(i, i // 5, rng.normal(0, 1, 64).tolist()) for i in range(100)] + [(200 + i, 3, rng.normal(0, 1, 64).tolist()) for i in range(30)] + [(300, 7, None)]
    pages = [(p, rng.normal(0, 1, 64).tolist(), 1.0 if p == 3 else p % 4 / 4) for p in range(20)]
    r = spark.createDataFrame(rows, "record_id long, page_id long, vector array<double>")
    p = spark.createDataFrame(pages, "page_id long, vector array<double>, importance double")
    out = P.consolidate(r, p, 8, 20, align=1.0).collect()
    where = {x["record_id"]: x["page_id"] for x in out}
    usable = {i: q for i, q in where.items() if i != 300}
    load = {q: list(usable.values()).count(q) for q in set(usable.values())}
    assert len(out) == len(where) == 131 and len(load) <= 8 and max(load.values()) <= 20 and where[300] == 7
    assert 3 in load and {x["record_id"] for x in out if not x["moved"]} >= {i for i, q in usable.items() if q == dict((a, b) for a, b, _ in rows)[i] and q != 3}
    # where the target has no room for all, as many pages stay as are needed
    out = P.consolidate(r, p, 2, 20, align=1.0).where("record_id <> 300").groupBy("page_id").count().collect()
    assert len(out) == 7 and max(x["count"] for x in out) <= 20 and sum(x["count"] for x in out) == 130
