"""A toxicity classifier with counterfactual regularisation.

Logistic regression over word and word-beginning indicators. Each labelled text that names an
identity group gives counterfactuals: each sentence that names one, with the group's term swapped
for another. The loss adds the squared change of the margin between a sentence and its
counterfactuals, so a neutral mention of a group moves no score. Fitted on a bounded sample of
labelled rows, applied to every row. Where no labelled text names a group there are no pairs, and
what is left is a logistic model with a ridge; Model.n_pairs tells.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import cut
from .features import BITS, compact, feature_rows, fit_apart, margins, of_text, sample, word_features

#: Labelled rows to fit on at most, swaps of one sentence, and counterfactual pairs at most; beyond
#: that the pairs are chosen by a hash.
MOST_ROWS, MOST_SWAPS, MOST_PAIRS = 12_000, 3, 50_000
#: Identity terms in English, French, German and Spanish; a term is swapped for the
#: others of its line.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "hispanic"),
    ("african", "european", "american", "mexican", "chinese", "arab", "indian"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("disabled", "deaf", "blind"),
    ("old", "young"),
    ("femmes", "hommes", "filles", "garçons"),
    ("femme", "homme", "fille", "garçon"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "arabes"),
    ("immigrés", "réfugiés", "étrangers"),
    ("handicapés", "sourds", "aveugles"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("frau", "mann"),
    ("muslime", "christen", "juden", "buddhisten", "atheisten"),
    ("schwule", "lesben", "heterosexuelle"),
    ("schwarze", "weiße", "asiaten", "araber"),
    ("einwanderer", "flüchtlinge", "ausländer"),
    ("behinderte", "gehörlose", "blinde"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("mujer", "hombre", "niña", "niño"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "árabes"),
    ("inmigrantes", "refugiados", "extranjeros"),
    ("discapacitados", "sordos", "ciegos"),
    ("jóvenes", "ancianos"),
)
_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")


@dataclass
class Model:
    weights: np.ndarray  # by bucket
    bias: float
    n_rows: int
    n_pairs: int


def swapper(terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, most: int = MOST_SWAPS) -> Callable[[str], list[tuple[str, str]]]:
    """A function from a text to its counterfactual pairs (sentence, sentence with its terms swapped).

    All identity terms of a sentence are moved on by 1 to `most` places in their lines; a term
    that stands in two lines belongs to the first.
    """
    place: dict[str, tuple[tuple[str, ...], int]] = {}
    for line in terms:
        for i, term in enumerate(line):
            place.setdefault(term.lower(), (line, i))
    if not place:
        return lambda text: []
    found = re.compile(r"\b(" + "|".join(map(re.escape, sorted(place, key=len, reverse=True))) + r")\b", re.IGNORECASE)

    def pairs(text: str) -> list[tuple[str, str]]:
        out: list[tuple[str, str]] = []
        if not found.search(text):
            return out
        for sentence in dict.fromkeys(_SENTENCE.findall(text)):
            if found.search(sentence):
                for step in range(1, most + 1):
                    moved = lambda m, step=step: (at := place[m[0].lower()])[0][(at[1] + step) % len(at[0])]
                    swapped = found.sub(moved, sentence)
                    if swapped.lower() != sentence.lower() and (sentence, swapped) not in out[-most:]:
                        out.append((sentence, swapped))
        return out

    return pairs


def select(rows: list[tuple[int, np.ndarray]], least_rows: int = 4, least_z: float = 2.5) -> np.ndarray:
    """Buckets in least_rows rows or more whose log-odds differ from 0 by least_z standard errors."""
    counts = np.zeros((2, 1 << BITS))
    total = np.zeros(2)
    for label, buckets in rows:
        counts[label][buckets] += 1
        total[label] += 1
    ratio = np.log((counts[1] + 0.5) / (total[1] + 1)) - np.log((counts[0] + 0.5) / (total[0] + 1))
    z = ratio / np.sqrt(1 / (counts[1] + 0.5) + 1 / (counts[0] + 0.5))
    return np.flatnonzero((counts.sum(axis=0) >= least_rows) & (np.abs(z) > least_z))


def _compact(rows: list[np.ndarray], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the chosen buckets."""
    starts, columns = compact(rows, chosen)
    return np.repeat(np.arange(len(rows)), np.diff(starts)), columns


def fit(rows: list[tuple[int, np.ndarray]], pairs: list[tuple[np.ndarray, np.ndarray]], strength: float = 1.0, ridge: float = 1.0, steps: int = 400) -> Model:
    """Weights that minimise log loss + strength * squared margin changes over pairs + ridge, by Adam."""
    labels = np.array([y for y, _ in rows], dtype=float)
    identity = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.setxor1d(a, b) for a, b in pairs)]))
    chosen = np.union1d(select(rows), identity.astype(np.int64)) if len(rows) else np.zeros(0, np.int64)
    n, m = len(chosen), max(1, len(rows))
    at, col = _compact([b for _, b in rows], chosen)
    pa_, ca = _compact([a for a, _ in pairs], chosen)
    pb, cb = _compact([b for _, b in pairs], chosen)
    w, bias = np.zeros(n), 0.0
    mean, square = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        margin = np.bincount(at, w[col], len(rows)) + bias
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels) / m
        grad = np.bincount(col, error[at], n) + ridge * w / m
        if len(pairs):
            change = np.bincount(pa_, w[ca], len(pairs)) - np.bincount(pb, w[cb], len(pairs))
            pull = 2 * strength * change / len(pairs)
            grad += np.bincount(ca, pull[pa_], n) - np.bincount(cb, pull[pb], n)
        g = np.append(grad, error.sum())
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        move = 0.05 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    weights = np.zeros(1 << BITS)
    weights[chosen] = w
    return Model(weights, bias, len(rows), len(pairs))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, trains: Callable[[Column], Column],
          terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, most: int = MOST_ROWS, strength: float = 1.0, most_pairs: int = MOST_PAIRS) -> Model:
    """Fits on at most `most` labelled rows, in one task; every sentence of theirs that names a group gives counterfactuals."""
    rows = cut(feature_rows(sample(docs, labels, id_col, text_col, label_col, trains, most), word_features, swapper(terms)))
    pairs = rows.where("label is null")
    if pairs.count() > most_pairs:
        pairs = pairs.orderBy(F.xxhash64("id", "buckets", "other"), "id").limit(most_pairs)
    out = fit_apart(rows.where("label is not null").union(pairs), lambda labelled, pairs: vars(fit(labelled, pairs, strength)))
    return Model(out["weights"], out["bias"], int(out["n_rows"]), int(out["n_pairs"]))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          trains: Callable[[Column], Column] | None = None, threshold: float = 0.7, **options) -> DataFrame:
    """(id, score, predicted), one row for each row of docs; only the labelled sample moves.

    trains says of an id, as text, whether its label may be learned; by default all may. score
    is in [0, 1]; predicted is 1 from the threshold on. Null and empty texts get the score of a
    text without features. Null labels, ids and texts are never learned from; labels of one id
    are averaged. Without any label every score is 0.5. Rows may repeat an id. Other columns
    aren't read, and an empty table gives an empty result.
    """
    model = train(docs, labels, id_col, text_col, label_col, trains or (lambda key: F.lit(True)), **options)
    return scored(docs, model, id_col, text_col, threshold)


def scored(docs: DataFrame, model: Model, id_col: str, text_col: str, threshold: float) -> DataFrame:
    out = margins(docs, id_col, text_col, word_features, model.weights, model.bias)
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), F.col("margin")))))
    return out.select("id", p.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def margin_of(model: Model, text: str) -> float:
    """The margin of one text."""
    return float(model.weights[of_text(text, word_features)].sum() + model.bias)

