"""Folds and rank sums against plain Python, at part and batch bounds."""

import random

import pytest

from palimpsest.operators import datasets as D
from palimpsest.operators import learned as N
from palimpsest.operators import ledger as L
from palimpsest.operators import metrics as M


def folded(rows, slots):
    """{(user, seq): (slot, action)} by the rule, a row at a time; held is [(last seq, text)] by slot."""
    out, banks = {}, {}
    for user, seq, text in sorted(rows, key=lambda r: r[1]):
        bank = banks.setdefault(user, [])
        at = next((i for i, (_, t) in enumerate(bank) if t == (text or "")), None)
        action = "touched"
        if at is None and len(bank) < slots:
            at, action = len(bank), "inserted"
            bank.append(None)
        elif at is None:
            at, action = min(range(slots), key=lambda i: bank[i][0]), "replaced"
        bank[at] = (seq, text or "")
        out[user, seq] = (at, action)
    return out


@pytest.mark.parametrize("batch", [3, 10_000])
def test_slots_are_folded_in_order(spark, batch):
    rng = random.Random(5)
    # user 1 has two thirds of all rows; some rows have neither user nor text
    rows = [(rng.choice([1, 1, 1, 1, 2, None]), seq, rng.choice(["a", "b", "c", "d", "e", "f", None])) for seq in range(400)]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = N.hot_slots(spark.createDataFrame(rows, "user_id long, seq long, text string"), 4).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {(r.user_id, r.seq): (r.slot, r.action) for r in found} == folded(rows, 4) and len(found) == len(rows)


def pair_share(rows):
    """Share of (positive, negative) pairs in the right order, half for ties; None without pairs."""
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return None if not pos or not neg else round(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)), 6)


@pytest.mark.parametrize("parts", [2, 7, 256])
def test_auc_is_the_share_of_ordered_pairs(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["x", None, "only"]), rng.choice([0.0, 0.25, rng.random()]), rng.random() < 0.4) for _ in range(500)]
    rows = [(g, s, y or g == "only") for g, s, y in rows]
    df = spark.createDataFrame([(g, s, int(y)) for g, s, y in rows], "g string, s double, y int")
    whole = M.auc(df, "s", "y", parts=parts).first()
    assert whole["auc"] == pair_share([r[1:] for r in rows]) and whole["n_positive"] + whole["n_negative"] == 500
    by = {r["g"]: r["auc"] for r in M.auc(df, "s", "y", "g", parts=parts).collect()}
    assert by == {g: pair_share([r[1:] for r in rows if r[0] == g]) for g in ("x", None, "only")}
    assert M.auc(df.where("false"), "s", "y", "g").count() == 0


def test_pages_beyond_the_target_move(spark):
    rows = [(i, i % 5 / 5, 10 + i % 3 * 20) for i in range(50)]
    found = L.consolidation_plan(spark.createDataFrame(rows, "page_id int, importance double, n_records int"), 12).collect()
    stay = {p for p, *_ in sorted(rows, key=lambda r: (-r[1], -r[2], r[0]))[:12]}
    assert len(found) == 50 and {r.page_id for r in found if r.move} == {p for p, _, n in rows if p not in stay and n < 32}


def test_splits_that_share_groups_are_told(spark):
    a, b = (spark.createDataFrame([(x,) for x in own], "g long") for own in ([1, 2, 3, None], [3, 3, 4, None]))
    assert [r.g for r in D.shared_keys(a, b, "g").collect()] == [3]
    with pytest.raises(ValueError, match="overlap"):
        D.assert_disjoint(a, b, "g")
    D.assert_disjoint(a, b.where("g = 4"), "g")


def test_batches_keep_to_their_budget(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([1, 1, 1, 7, 40, 200])) for i in range(300)]
    found = D.length_batches(spark.createDataFrame(rows, "doc_id long, n_tokens long"), 100, order="doc_id", parts=4).collect()
    used = {}
    for r in found:
        used.setdefault((r.n_tokens, r.part, r.batch), []).append(r.doc_id)
    assert sorted(i for ids in used.values() for i in ids) == list(range(300))
    assert all(n * len(ids) <= 100 or len(ids) == 1 for (n, *_), ids in used.items())
