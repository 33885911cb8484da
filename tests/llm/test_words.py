import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import words as W

WORD = re.compile("[^\x20\x09-\x0d]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aB é\n\t\x0b　字*."), max_size=40)), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    found = [[] for _ in texts]
    for step in W.words_of(pa.array(texts, pa.string()), limit=16):
        for s, e, r in zip(step.starts, step.ends, step.row, strict=True):
            found[step.first + r].append(step.data[s:e].tobytes().decode())
    assert found == [WORD.findall(t or "") for t in texts]


def test_shingles_are_sets_of_runs():
    texts = ["a b c d e f", "A b c d e f", "a b c d e a b c d e", "a b", "a  b", "", None]
    sets = [None] * len(texts)
    for step in W.words_of(pa.array(texts), lower=True):
        rows, hashes = W.shingles_of(step)
        for i in range(step.n_rows):
            sets[step.first + i] = set(hashes[rows == i].tolist())
    assert sets[0] == sets[1] and [len(s) for s in sets] == [2, 2, 5, 1, 1, 0, 0] and sets[3] == sets[4]


def test_equal_hashes_only_for_equal_words():
    words = [f"{a}{b}" for a in ("", "a", "b", "ab", "ba", "éa") for b in range(300)]
    step = next(W.words_of(pa.array([" ".join(words)])))
    assert len(np.unique(step.hashes)) == len(set(words))


def test_long_words_that_collide_modulo_powers_of_two():
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    one, other = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    step = next(W.words_of(pa.array([f"{one} {other} {one.upper()} {one}x"]), lower=True))
    assert len(set(step.hashes.tolist())) == 3 and step.hashes[0] == step.hashes[2]
