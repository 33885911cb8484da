import random

import pytest

WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi", "omicron", "pi", "rho", "Sigma", "TAU", "ärger", "été"]


def make_texts(seed=1, n=120):
    """Texts with copies, near copies, shared passages, runs of one word, odd white space, and nothing."""
    rng = random.Random(seed)
    say = lambda k: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(k))
    passage = say(70)
    out = [None, "", " \t\n", "one", "one two three four", "One two  three\tfour", "a " * 600, "same line\n" * 30, "x" * 1500, passage]
    while len(out) < n:
        kind = rng.randrange(6)
        base = rng.choice([t for t in out if t and len(t) > 200] or [say(60)])
        if kind == 0:
            out.append(base)
        elif kind == 1:
            w = base.split(" ")
            w[rng.randrange(len(w))] = "edited"
            out.append(" ".join(w))
        elif kind == 2:
            out.append(say(rng.randrange(30)) + " " + passage + " " + say(rng.randrange(30)))
        elif kind == 3:
            out.append(base.replace(" ", "\n", 3).upper())
        else:
            out.append(say(rng.randrange(5, 150)))
    return out


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Documents with further columns, some with names that operators use inside."""
    rows = [(i, t, ("en", "fr", None)[i % 3], None if i % 9 == 8 else f"src{0 if i % 3 else i % 7}", i, i, "x", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id long, block string, n int").repartition(5)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")
