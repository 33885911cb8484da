"""The n-gram join and the suffix-array dedup against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import components, ngram_join, suffix_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_sets(texts):
    out = []
    for t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def linked_components(sets):
    head = list(range(len(sets)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            k = len(a & sets[j])
            if k and 100 * k >= 75 * (len(a) + len(sets[j]) - k):
                x, y = find(i), find(j)
                head[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("block_rows", [20_000, 3])
def test_join_finds_all_components(docs, texts, block_rows):
    sets = shingle_sets(texts)
    rows = ngram_join.ngram_components(docs, block_rows=block_rows).collect()
    assert len(rows) == len(texts)
    assert {r.id: (r.n_shingles, r.component_id) for r in rows} == {i: (len(sets[i]), c) for i, c in enumerate(linked_components(sets))}


def test_join_links_across_the_chunks_of_a_split_block(spark):
    """Three texts share a passage, two of them link, and a block of three is split."""
    rows = []
    for i in range(0, 90, 3):
        say = lambda name, k, i=i: [f"{name}{i}x{j}" for j in range(k)]
        passage = say("p", 60)
        rows += [(i + j, " ".join(passage + say("uvw"[j], (3, 4, 30)[j]))) for j in range(3)]
    want = linked_components(shingle_sets([t for _, t in rows]))
    assert [want[i] for i in range(3)] == [0, 0, 2]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.id: r.component_id for r in ngram_join.ngram_components(df, block_rows=2).collect()} == dict(enumerate(want))


def test_first_round_marks_what_it_does_not_pair():
    """Every pair of a block that the coarse bound leaves is paired, or marked at both ends."""
    rng = np.random.default_rng(3)
    common = rng.integers(0, 2**63, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate([common[: 200 - 2 * (i % 20)], rng.integers(0, 2**63, i % 20).astype(np.uint64)])) for i in range(60)]
    n = [len(s) for s in sets]
    vectors = [ngram_join.count_vector(s, ngram_join.COARSE) for s in sets]
    block = pa.RecordBatch.from_pydict({
        "block": [7] * 60, "id": list(range(60)), "n": n, "component": list(range(60)), "chunk": [0] * 60,
        "vector": [v.tobytes() for v in vectors], "names": [[]] * 60, "name": [9] * 60,
    })
    out = pa.Table.from_batches(ngram_join._search(75, True)(iter([block]))).to_pylist()
    told = {(r["u"], r["v"]) for r in out if r["block"] is None}
    marked = {r["u"] for r in out if r["block"] == 9}
    assert told and marked
    for i in range(60):
        for j in range(i + 1, 60):
            if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j])):
                assert (i, j) in told or {i, j} <= marked


def test_join_of_nothing_and_of_null_ids(spark, nothing):
    assert ngram_join.ngram_components(nothing).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, None)], "doc_id long, text string")
    assert sorted((str(r.id), r.component_id) for r in ngram_join.ngram_components(rows).collect()) == [("3", 3), ("3", 3), ("4", 4), ("None", 3)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + i] == 100 for i in range(30)) and got[201] == 200


def expected_removal(texts, least):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[s : s + least] for b in data for s in range(len(b) - least + 1))
    out = {}
    for i, b in enumerate(data):
        runs = []
        for s in range(len(b) - least + 1):
            if seen[b[s : s + least]] > 1:
                if runs and s <= runs[-1][1]:
                    runs[-1][1] = s + least
                else:
                    runs.append([s, s + least])
        kept, at = b"", 0
        for x, y in runs:
            kept, at = kept + b[at:x], y
        out[i] = (len(b), sum(y - x for x, y in runs), len(runs), hashlib.sha256(kept + b[at:]).hexdigest())
    return out


@pytest.mark.parametrize(("least", "anchor", "group_rows"), [(400, 160, 4_000), (400, 160, 2), (60, 20, 4_000), (60, 20, 1)])
def test_repeats_are_removed_to_the_byte(docs, texts, least, anchor, group_rows):
    rows = suffix_dedup.remove_repeats(docs, least=least, anchor=anchor, group_rows=group_rows).collect()
    assert {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == expected_removal(texts, least)
    assert all(r.repeats == (r.n_removed > 0) for r in rows)


@pytest.mark.parametrize("group_rows", [3, 4_000])
def test_a_passage_of_many_texts_is_split(spark, group_rows):
    """A common passage at any place, cut at any length, in texts that also share more with some others."""
    rng = np.random.default_rng(group_rows)
    say = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    common, texts = say(180), []
    for i in range(90):
        left, right = say(rng.integers(0, 90)), say(rng.integers(0, 90))
        if i % 3 and texts:
            other = texts[-1].split(common[40:90])
            left, right = (say(3) + other[0][rng.integers(0, 9) :], right) if i % 2 else (left, other[-1] + say(4))
            texts.append(left + common[40:90].join(["", ""]) + right if rng.random() < 0.5 else left + common + right)
        else:
            texts.append(left + common[: rng.integers(60, 181)] + right)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = suffix_dedup.remove_repeats(df, least=60, anchor=24, group_rows=group_rows).collect()
    assert {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == expected_removal(texts, 60)


def test_windows_of_one_hash_are_no_repeats(spark):
    """Two windows of a text that differ and were made to have one hash and one anchor; then also a true repeat of one of them."""
    change = {150: 3, 160: 3, 170: 1, 180: 1, 190: -4, 200: 2, 210: 1, 220: -2, 410: -4, 430: 4, 440: -2, 460: 3, 480: 1, 490: 1, 500: -2, 510: -1, 520: 3}
    for seed in range(1000):
        rng = np.random.default_rng(seed)
        say = lambda n: rng.integers(101, 119, n, dtype=np.uint8)
        one = say(640)
        other = one.copy()
        other[list(change)] += np.array(list(change.values()), dtype=np.int8).view(np.uint8)
        data = np.concatenate([say(300), one, say(300), other, say(300)])
        found, places = suffix_dedup.anchors(data, np.array([0, len(data)]), 400, 160)
        if {540, 1480} <= set(places.tolist()):
            break
    hashes = suffix_dedup.window_hashes(data, 640)
    assert hashes[300] == hashes[1240] and found[places == 540] == found[places == 1480]
    texts = [data.tobytes().decode(), np.concatenate([data, say(300), one, say(300), other]).tobytes().decode()]
    for some in ([texts[0]], [texts[1]], texts):
        df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
        rows = suffix_dedup.remove_repeats(df).collect()
        assert {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == expected_removal(some, 400)


def test_repeats_of_nothing(nothing):
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_prefix_intervals():
    assert sorted(suffix_dedup.prefix_intervals([1, 3, 0, 2])) == [(0, 0, 4), (1, 0, 2), (2, 3, 4), (3, 1, 2)]


def test_maximal_repeats_extend_both_ways():
    before, after = [b"cba", b"cbx", b"cba"], [b"xyz1", b"xyz2", b"xq"]
    found = {(l, r, tuple(sorted(m))) for l, r, m in suffix_dedup.maximal_repeats(before, after, 4)}
    assert found == {(2, 3, (0, 1)), (3, 1, (0, 2))}
