"""Rules on a text's words, symbols and repetition, the last by a suffix array.

For every text, a suffix array over its words is built by prefix doubling, many texts at once.
A place's longest repeat is its longer common prefix with its two neighbours there; the spans of
all repeats of three words and more are united. A stack scan over the common-prefix lengths gives
the prefix intervals; those whose members follow different words are the maximal repeats. The
united spans and the longest repeat decide, beside the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .suffix_dedup import prefix_intervals
from .words import STEP_BYTES, Words, mix, powers, run_hashes, words_of

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """A text fails with fewer than min_words words, or more than max_repeat percent of its
    words in repeated windows (base); with more than max_covered percent of its words' code
    points in maximal repeats of window words and more, or max_short percent in those of
    short_window words and more, or a repeat of more than max_longest words (suffix array).

    max_short is set on the labelled documents of sf0.1: of the 3,302 good ones that pass the other
    limits none has more than 27.6 percent, while texts made of short repeats have 78 to 100.
    """

    window: int = 8
    min_words: int = 20
    max_repeat: int = 30
    max_covered: int = 30
    short_window: int = 3
    max_short: int = 30
    max_longest: int = 250


_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def suffix_array(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Places sorted by row, then by the values from the place to the end of its row."""
    n = len(values)
    end = np.searchsorted(row, row, side="right")
    order = np.lexsort((values, row))
    new = np.concatenate([[True], (values[order[1:]] != values[order[:-1]]) | (row[order[1:]] != row[order[:-1]])])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    step = 1
    while True:
        size = np.bincount(rank, minlength=n)
        tied = np.flatnonzero(size[rank] > 1)
        if not len(tied):
            break
        ahead = np.where(tied + step < end[tied], rank[np.minimum(tied + step, n - 1)] + 1, 0)
        o = np.lexsort((ahead, rank[tied]))
        r, a = rank[tied][o], ahead[o]
        fresh = np.concatenate([[True], r[1:] != r[:-1]])
        split = fresh | np.concatenate([[True], a[1:] != a[:-1]])
        place = np.arange(len(o))
        first = np.maximum.accumulate(np.where(fresh, place, 0))
        within = np.maximum.accumulate(np.where(split, place, 0)) - first
        rank[tied[o]] = r + within
        step *= 2
    out = np.empty(n, dtype=np.int64)
    out[rank] = np.arange(n)
    return out


def common_words(values: np.ndarray, row: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values from a and b on are equal, within their rows."""
    power, inverse = powers(len(values))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values * power[: len(values)], dtype=np.uint64)])
    end = np.searchsorted(row, row, side="right")
    low = np.zeros(len(a), dtype=np.int64)
    high = np.minimum(end[a] - a, end[b] - b)
    high[row[a] != row[b]] = 0
    while (open_ := low < high).any():
        mid = (low + high + 1) // 2
        same = (sums[a + mid] - sums[a]) * inverse[a] == (sums[b + mid] - sums[b]) * inverse[b]
        low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
    return low


def maximal_repeats(values: np.ndarray, row: np.ndarray, order: np.ndarray, depth: np.ndarray, least: int) -> np.ndarray:
    """The row of each maximal repeat of `least` values or more: one entry for each repeat.

    order is the suffix array, depth the values that neighbours in it share. An interval of common
    prefixes is a maximal repeat if its members follow different values; its places aren't walked.
    """
    left = np.where((order > 0) & (row[np.maximum(order - 1, 0)] == row[order]), values[np.maximum(order - 1, 0)], np.uint64(0))
    alone = (order == 0) | (row[np.maximum(order - 1, 0)] != row[order])
    differs = np.concatenate([[0], np.cumsum((left[1:] != left[:-1]) | alone[1:] | alone[:-1])])
    deep = np.concatenate([[False], depth >= least, [False]])
    firsts, lasts = np.flatnonzero(deep[1:] & ~deep[:-1]), np.flatnonzero(deep[:-1] & ~deep[1:])
    found = []
    for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True):
        told = differs[a : b + 1].tolist()
        n = sum(d >= least and told[j] > told[i] for d, i, j in prefix_intervals(depth[a:b].tolist()))
        found += [row[order[a]]] * n
    return np.array(found, np.int64)


def _sum_by_row(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[cuts])


def measures(words: Words, rules: Rules) -> dict[str, np.ndarray]:
    """The measures of every row of a step."""
    data, offs, row, n_rows = words.data, words.offsets, words.row, words.n_rows
    out = {"n_words": np.diff(words.bounds)}
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = lead[words.ends] - lead[words.starts]
    out["word_chars"] = np.bincount(row, chars, n_rows).astype(np.int64)
    out["n_symbols"] = _sum_by_row(_SYMBOL[data], offs)

    # lines: from each text's start or a newline on, up to the next one
    breaks = np.flatnonzero(data == 0x0A)
    begin = np.unique(np.concatenate([offs[:-1][np.diff(offs) > 0], breaks + 1])) if len(data) else np.zeros(0, np.int64)
    begin = begin[begin < len(data)]
    owner = np.searchsorted(offs, begin, side="right") - 1
    stop = np.minimum(np.append(begin[1:], len(data)), offs[owner + 1])
    stop = stop - (data[stop - 1] == 0x0A) if len(begin) else stop
    filled = np.searchsorted(words.starts, stop) > np.searchsorted(words.starts, begin)
    power, inverse = powers(len(data))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64)])
    line = mix((sums[stop] - sums[begin]) * inverse[begin] + (stop - begin).astype(np.uint64))[filled]
    owner = owner[filled]
    _, first = np.unique(mix(line + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    out["n_dup_lines"] = np.bincount(owner, minlength=n_rows) - np.bincount(owner[first], minlength=n_rows)

    # windows found twice
    k, n = rules.window, len(row)
    h = run_hashes(words.hashes, k)
    at = np.flatnonzero(row[: len(h)] == row[k - 1 :]) if len(h) else np.zeros(0, np.int64)
    key = mix(h[at] + row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(at), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    at = at[again]
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    out["n_repeat_words"] = np.bincount(row, np.cumsum(edge[:-1]) > 0, n_rows).astype(np.int64)

    # repeats by the suffix array: a place's longest repeat, and the number of maximal ones. A place's
    # longest repeat that isn't maximal lies within that of the place before, so the spans are the same
    longest, repeats = np.zeros(n_rows, dtype=np.int64), np.zeros(n_rows, dtype=np.int64)
    edge[:] = 0
    short = edge.copy()
    if n > 1:
        suffixes = suffix_array(words.hashes, row)
        depth = common_words(words.hashes, row, suffixes[:-1], suffixes[1:])
        reach = np.empty(n, dtype=np.int64)
        reach[suffixes] = np.maximum(np.append(depth, 0), np.append(0, depth))
        for spans, least in ((short, rules.short_window), (edge, k)):
            at = np.flatnonzero(reach >= least)
            np.add.at(spans, at, 1)
            np.add.at(spans, at + reach[at], -1)
        np.maximum.at(longest, row[at], reach[at])
        repeats = np.bincount(maximal_repeats(words.hashes, row, suffixes, depth, k), minlength=n_rows)
    out["covered_chars"] = np.bincount(row, chars * (np.cumsum(edge[:-1]) > 0), n_rows).astype(np.int64)
    out["short_repeat_chars"] = np.bincount(row, chars * (np.cumsum(short[:-1]) > 0), n_rows).astype(np.int64)
    out["longest_repeat"], out["n_repeats"] = longest, repeats
    return out


_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_chars", "short_repeat_chars", "longest_repeat", "n_repeats")


def _rows(rules: Rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in words_of(batch.column(1), limit=STEP_BYTES):
                m = measures(words, rules)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(words.first, words.n_rows), *(pa.array(m[c], pa.int64()) for c in _COLUMNS)], names=["id", *_COLUMNS]
                )

    return run


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """One row of measures and verdicts for each row of docs; no shuffle.

    id_col must be a long and may be null or repeated: each row is judged alone. Null and
    empty texts have no words, so they fail the least number of words. Very long texts are
    judged whole. An empty table gives an empty result; other columns are not read.
    """
    kinds = "id long, " + ", ".join(f"{c} long" for c in _COLUMNS)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_rows(rules), kinds)
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat * F.col("n_words"))
    repeated = (100 * F.col("covered_chars") > rules.max_covered * F.col("word_chars")) | (F.col("longest_repeat") > rules.max_longest)
    repeated = repeated | (100 * F.col("short_repeat_chars") > rules.max_short * F.col("word_chars"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & ~repeated)
