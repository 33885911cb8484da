import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import phrases, queries


def pieces_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = (re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower))
    return [p for p in found if p]


def by_hand(rows, longest=4, least=30, top=2000):
    """Counts of all phrases, cut by cut."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces_of(text):
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    candidates = {c: a for c, a in f.items() if len(c) > 2 and a >= least}
    gone = set()
    for c, a in candidates.items():
        for i in range(1, len(c)):
            for j in range(i + 2, len(c) + 1):
                part = (c[0], *c[i:j])
                if len(part) < len(c) and 100 * a >= 80 * candidates[part]:
                    gone.add(part)
    out = {}
    for c, a in candidates.items():
        cuts = [(2000000 * a // (f[c[:j]] + f[(c[0], *c[j:])]), j, f[c[:j]], f[(c[0], *c[j:])]) for j in range(2, len(c))]
        if c not in gone:
            score, _, le, r = min(cuts)
            out.setdefault(c[0], []).append((-score, -a, " ".join(c[1:]).encode(), le, r))
    return sorted((lang, i, p.decode(), -a, le, r, n[lang], -s) for lang, own in out.items() for i, (s, a, p, le, r) in enumerate(sorted(own)[:top], 1))


def made(seed, n=150, words=12):
    rng = random.Random(seed)
    vocabulary = [rng.choice("abcdefg") * rng.randrange(1, 4) + rng.choice(["", "É", "ß", "X"]) for _ in range(words)]
    say = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "!"]) for _ in range(rng.randrange(60)))
    out = [(rng.choice(["en", "de", None]), say()) for _ in range(n)]
    return out + [("en", "New York City is new york city, NEW YORK city")] * 40 + [("en", None), (None, ""), ("fr", " .;\n"), ("und", "aa bb")] + [("xx", "one " * 3000)]


def frame(spark, rows):
    return spark.createDataFrame([(1, t, lang, 3, "x", 5, 6) for lang, t in rows], "doc_id long, text string, lang string, n long, phrase string, f int, m int").repartition(4)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aB é\n\t\x0b.,　字"), max_size=30)), max_size=8))
def test_pieces_are_those_of_the_patterns(texts):
    found = [[] for _ in texts]
    for row, piece, n in phrases.split_pieces(pa.array(texts, pa.string())):
        for r, p, k in zip(row, piece.to_pylist(), n, strict=True):
            found[r].append(p.split(" "))
            assert len(found[r][-1]) == k
    assert found == [pieces_of(t) for t in texts]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_counting_by_hand(spark, seed):
    rows = made(seed)
    got = sorted(tuple(r) for r in phrases.collocations(frame(spark, rows), least=9).collect())
    assert got == by_hand(rows, least=9) and len(got) > 20


def test_other_lengths_and_few_rows_kept(spark):
    rows = made(3, 60)
    assert sorted(tuple(r) for r in phrases.collocations(frame(spark, rows), longest=3, least=5, top=7).collect()) == by_hand(rows, 3, 5, 7)
    assert sorted(tuple(r) for r in phrases.collocations(frame(spark, rows), longest=2, least=5).collect()) == by_hand(rows, 2, 5)


def test_nothing_frequent(spark):
    assert phrases.collocations(frame(spark, [("en", "one two three"), (None, None)])).collect() == []
    assert phrases.collocations(frame(spark, made(1)).where("false")).collect() == []


def test_false_hits_change_nothing(spark):
    rows = phrases.table(phrases.pieces(frame(spark, made(4, 80, 400))), "pieces")
    few, many = (phrases.counts(rows, 3, 3, size) for size in (phrases.CHUNK, 1 << 24))
    for a, b in zip(few, many, strict=True):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_buckets_spill(spark):
    rows = spark.range(400_000).selectExpr("'en' AS lang", "concat('some rather long phrase with the number ', id % 200000) AS phrase", "2L AS n")
    got = phrases.count_buckets(rows.coalesce(1), 4, memory="20MB").selectExpr("count(*)", "min(f)", "max(f)").first()
    assert tuple(got) == (200_000, 4, 4)


def test_scores_of_products_beyond_64_bits(spark):
    big = 10**13
    known = spark.createDataFrame([("en", "a", 3 * big), ("en", "b", 2 * big + 1)], "lang string, phrase string, f long")
    out = phrases.scored(spark.createDataFrame([("en", "a b", big + 7)], "lang string, phrase string, f long"), known, 2).first()
    assert out["score"] == 2000000 * (big + 7) // (5 * big + 1)


def test_query_takes_whole_texts(spark, sf_dir):
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op11_phrases(spark, sf_dir).collect()) == by_hand(rows)
