"""A quality classifier: naive Bayes support vectors.

Each n-gram indicator is scaled by the log ratio of its smoothed frequencies in the two
classes; a linear model with hinge loss is then fitted on the scaled rows by dual coordinate
descent. A logistic curve over the training margins turns a margin into a score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import tidy
from .features import BITS, compact, feature_rows, fit_apart, margins, row_margins, sample, shape_features, slices
from .words import words_of

#: Labelled rows to fit on at most; rows that hold an n-gram at least; and n-grams kept.
MOST_ROWS, LEAST_ROWS, MOST_FEATURES = 8000, 5, 1 << 16


@dataclass
class Model:
    weights: np.ndarray  # by bucket: log ratio times support vector weight, by row norm
    bias: float
    slope: float
    shift: float
    n_rows: int


def log_ratios(labels: np.ndarray, rows: list[np.ndarray], smooth: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Log ratio of each bucket's share in class 1 to that in class 0, and its number of rows."""
    counts = np.zeros((2, 1 << BITS), dtype=np.int64)
    for k in (0, 1):
        for part in slices([r for r, y in zip(rows, labels, strict=True) if y == k]):
            counts[k] += np.bincount(part, minlength=1 << BITS)
    ratio = np.log(counts[1] + smooth) - np.log(counts[0] + smooth)
    ratio -= np.log((counts[1].sum() + smooth * (1 << BITS)) / (counts[0].sum() + smooth * (1 << BITS)))
    return ratio, counts[0] + counts[1]


def dual_descent(starts: np.ndarray, columns: np.ndarray, values: np.ndarray, labels: np.ndarray, n: int, cost: np.ndarray, epochs: int = 30, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear hinge-loss model, one dual variable at a time.

    Row i has values[starts[i] : starts[i + 1]] in the columns of that slice.
    """
    w, bias = np.zeros(n), 0.0
    alpha = np.zeros(len(labels))
    rows = [(columns[a:b], values[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
    norm = np.array([float(v @ v) + 1 for _, v in rows])
    order = np.arange(len(rows))
    shuffle = np.random.default_rng(seed)
    for _ in range(epochs):
        shuffle.shuffle(order)
        most = 0.0
        for i in order:
            own, v = rows[i]
            gradient = labels[i] * (float(w[own] @ v) + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * labels[i]
            if step:
                w[own] += step * v
                bias += step
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-4:
            break
    return w, bias


def logistic_of(margin: np.ndarray, labels: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and shift of the logistic curve that fits labels best, by Newton's method."""
    a, b = 1.0, 0.0
    target = np.where(labels == 1, (np.sum(labels == 1) + 1) / (np.sum(labels == 1) + 2), 1 / (np.sum(labels == 0) + 2))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([np.sum((p - target) * margin), np.sum(p - target)])
        v = p * (1 - p) + 1e-9
        h = np.array([[np.sum(v * margin * margin) + 1e-3, np.sum(v * margin)], [np.sum(v * margin), np.sum(v) + 1e-3]])
        move = np.linalg.solve(h, g)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-8:
            break
    return float(a), float(b)


def fit(rows: list[tuple[int, np.ndarray]], cost: float = 0.1) -> Model:
    """The model of (label, sorted buckets) rows; the rarer class weighs as much as the other.

    The curve from margins to scores is fitted on margins of rows that the weights haven't
    seen: those of three folds.
    """
    labels = np.array([y for y, _ in rows])
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(np.zeros(1 << BITS), 0.0, 1.0, float(np.log(share / (1 - share))), len(rows))

    def weigh(part: np.ndarray) -> tuple[np.ndarray, float]:
        own = [rows[i][1] for i in part]
        ratio, seen = log_ratios(labels[part], own)
        chosen = np.flatnonzero(seen >= LEAST_ROWS)
        chosen = np.sort(chosen[np.argsort(-np.abs(ratio[chosen]), kind="stable")[:MOST_FEATURES]])
        starts, columns = compact(own, chosen)
        values = ratio[chosen].astype(np.float32)[columns]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            values[a:b] /= max(1.0, np.sqrt(b - a))
        y = np.where(labels[part] == 1, 1.0, -1.0)
        each = np.where(y > 0, len(y) / (2 * np.sum(y > 0)), len(y) / (2 * np.sum(y < 0))) * cost
        w, bias = dual_descent(starts, columns, values, y, len(chosen), each)
        out = np.zeros(1 << BITS)
        out[chosen] = w * ratio[chosen]
        return out, bias

    def margin(weights: np.ndarray, bias: float, buckets: np.ndarray) -> float:
        used = weights[buckets]
        used = used[used != 0]
        return float(used.sum() / max(1.0, np.sqrt(len(used)))) + bias

    fold = np.arange(len(rows)) % 3
    held = np.zeros(len(rows))
    for k in range(3):
        w, bias = weigh(np.flatnonzero(fold != k))
        for i in np.flatnonzero(fold == k):
            held[i] = margin(w, bias, rows[i][1])
    slope, shift = logistic_of(held, labels)
    if slope <= 0:  # the margins tell nothing of unseen rows: every score is the share of ones
        slope, shift = 0.0, float(np.log((np.sum(labels == 1) + 1) / (np.sum(labels == 0) + 1)))
    w, bias = weigh(np.arange(len(rows)))
    return Model(w, bias, slope, shift, len(rows))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, trains: Callable[[Column], Column], most: int = MOST_ROWS, cost: float = 0.1) -> Model:
    """Fits on at most `most` labelled rows, in one task."""
    rows = feature_rows(sample(docs, labels, id_col, text_col, label_col, trains, most), shape_features)
    out = fit_apart(rows, lambda labelled, _: vars(fit(labelled, cost)))
    return Model(out["weights"], out["bias"], out["slope"], out["shift"], int(out["n_rows"]))


def scored(docs: DataFrame, model: Model, id_col: str, text_col: str, threshold: float) -> DataFrame:
    out = margins(docs, id_col, text_col, shape_features, model.weights, model.bias, by_root=True)
    z = model.slope * F.col("margin") + model.shift
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z))))
    return out.select("id", p.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          trains: Callable[[Column], Column] | None = None, threshold: float = 0.3, **options) -> DataFrame:
    """(id, score, predicted), one row for each row of docs; only the labelled sample moves.

    trains says of an id, as text, whether its label may be learned; by default all may. score
    is in [0, 1]; predicted is 1 from the threshold on. Null and empty texts get the score of a
    text without features. Null labels, ids and texts are never learned from; labels of one id
    are averaged. If all labels agree, or there are none, every score is their share of ones, or
    0.5; if the margins rank unseen rows of the sample the wrong way round or not at all, it is the
    share of ones among them, one more of each counted. Rows may repeat an id. Other columns aren't
    read; an empty table gives an empty result.
    """
    model = train(docs, labels, id_col, text_col, label_col, trains or (lambda key: F.lit(True)), **options)
    return scored(docs, model, id_col, text_col, threshold)


def keep(docs: DataFrame, model: Model, text_col: str, threshold: float) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns; nothing moves.

    As in `scored`, with a slope of 0 all rows have one score, so all stay or all go.
    """
    at = docs.columns.index(text_col)
    short = float(np.log(threshold / (1 - threshold)) - model.shift)
    least = short / model.slope if model.slope > 0 else -np.inf if short <= 0 else np.inf
    shared = docs.sparkSession.sparkContext.broadcast(model.weights.astype(np.float32))
    bias = model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [row_margins(words, shape_features, shared.value, bias, True) for words in words_of(batch.column(at))]
            good = np.concatenate([np.zeros(0), *marks]) >= least
            yield batch if good.all() else batch.filter(pa.array(good))

    return docs.mapInArrow(tidy(run), docs.schema)
