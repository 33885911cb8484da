"""Removing long byte strings that occur more than once, by common-prefix interval trees.

A string of `least` bytes that starts at two places is a repeat; matches never cross texts.
The work is dealt out by anchors. Of the ANCHOR-byte strings in every window of `least`
bytes, the one with the least hash (the last one among equals) is the window's anchor, so
that two equal windows have equal anchors at the same place in the window. The anchors that
occur once can't lie in a repeat; the others form groups, and each group has its own
enhanced suffix array: the suffixes that start at the anchor, sorted, with the lengths of
their common prefixes. A stack scan over those lengths yields the common-prefix intervals.
In an interval of depth d every two suffixes share d bytes; where the bytes before them
differ (left-extension diversity), members fall into sub-groups by how far they agree to the
left, which makes the maximal repeats with all their occurrences. Exact copies of a whole text
are found beforehand, and only one of them takes part. Groups of many members, as a passage of
many texts makes, are split by the bytes around the anchor first.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import cut
from .cluster import table as _table
from .words import mix, powers, steps, utf8_of

LEAST, ANCHOR = 400, 160
#: A group with more members is split by the bytes around the anchor. Bands that a band is cut into.
GROUP_ROWS, BANDS = 4_000, 4
_PLACE_BITS = np.uint64(30)

_BYTE = np.arange(1, 257, dtype=np.uint64)


def _prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return sums, inverse


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of the `width` bytes from each place on."""
    if len(data) < width:
        return np.zeros(0, np.uint64)
    sums, inverse = _prefix_hash(data)
    n = len(data) - width + 1
    return mix((sums[width:] - sums[:n]) * inverse[:n])


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    n = len(keys)
    pad = -n % width
    full = np.concatenate([keys, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return np.minimum(behind[:m], ahead[width - 1 : width - 1 + m])


def anchors(data: np.ndarray, offsets: np.ndarray, least: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor hashes and places of all texts in data."""
    hashes = window_hashes(data, size)
    width = least - size + 1
    if len(hashes) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    last = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    keys = (hashes >> _PLACE_BITS << _PLACE_BITS) | (last - np.arange(len(hashes), dtype=np.uint64))
    low = _sliding_min(keys, width)
    ok = np.zeros(len(low) + 1, dtype=np.int32)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= least:
            ok[a] += 1
            ok[b - least + 1] -= 1
    inside = np.cumsum(ok[:-1]) > 0
    places = np.unique((last - (low[inside] & last)).astype(np.int64))
    return hashes[places], places


def _equal_windows(data: np.ndarray, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Whether the `width` bytes from each place of a on are those from the same row of b on."""
    out = np.zeros(len(a), dtype=bool)
    for i in range(0, len(a), 1024):
        windows = np.lib.stride_tricks.sliding_window_view(data, width)
        out[i : i + 1024] = (windows[a[i : i + 1024]] == windows[b[i : i + 1024]]).all(axis=1)
    return out


def _anchor_rows(least: int, size: int):
    """(id, anchors, places, runs): runs are the spans that the text itself repeats around equal anchors."""
    back, whole = least - size, 2 * least - size

    def collapsed(data: np.ndarray, offs: np.ndarray, found: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        around = window_hashes(data, whole)
        owner = np.searchsorted(offs, places, side="right") - 1
        inside = (places - back >= offs[owner]) & (places - back + whole <= offs[owner + 1])
        at = np.flatnonzero(inside)
        key = np.stack([owner[at].astype(np.uint64), found[at], around[places[at] - back]])
        order = np.lexsort(key)
        same = (key[:, order[1:]] == key[:, order[:-1]]).all(axis=0)
        # Some pairs of windows, made for it, have one hash: the bytes decide. What differs stays for the groups.
        near, starts = np.flatnonzero(same), places[at[order]] - back
        same[near] = _equal_windows(data, starts[near], starts[near + 1], whole)
        again, one = np.zeros(len(at), dtype=bool), np.zeros(len(at), dtype=bool)
        again[order[1:][same]] = True
        one[order[:-1][same]] = True
        runs: list[list[dict]] = [[] for _ in range(len(offs) - 1)]
        for p, o in zip(places[at[again | one]].tolist(), owner[at[again | one]].tolist(), strict=True):
            start, end = p - back - int(offs[o]), p - back + whole - int(offs[o])
            if runs[o] and start <= runs[o][-1]["end"]:
                runs[o][-1]["end"] = end
            else:
                runs[o].append({"start": start, "end": end})
        keep = np.ones(len(places), dtype=bool)
        keep[at[again]] = False
        return found[keep], places[keep], runs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            raw, offsets = utf8_of(batch.column(1))
            for i, j in steps(offsets):
                offs = offsets[i : j + 1] - offsets[i]
                data = raw[offsets[i] : offsets[j]]
                found, places, runs = collapsed(data, offs, *anchors(data, offs, least, size))
                cuts = np.searchsorted(places, offs).astype(np.int32)
                own = places - np.repeat(offs[:-1], np.diff(cuts))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(cuts), pa.array(found.view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(own.astype(np.int32))), pa.array(runs, span),
                ], names=["id", "anchors", "places", "runs"])

    return run


def _contexts(least: int, size: int):
    """The bytes around each anchor in `marks` (place, anchor, members)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8_of(batch.column(1))
            ids, marks = batch.column(0).to_pylist(), batch.column(2)
            place, anchor, members = (marks.flatten().field(x).to_numpy() for x in range(3))
            cuts = np.concatenate([[0], np.cumsum([len(x) for x in marks])])
            rows: list[tuple] = []
            for r in range(len(batch)):
                text = raw[offsets[r] : offsets[r + 1]].tobytes()
                for x in range(cuts[r], cuts[r + 1]):
                    p = int(place[x])
                    rows.append((int(anchor[x]), int(members[x]), ids[r], p, text[max(0, p - least + size) : p][::-1], text[p : p + least]))
                if len(rows) > 4000 or r == len(batch) - 1:
                    cols = list(zip(*rows, strict=True)) or [()] * 6
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["anchor", "members", "id", "place", "before", "after"])
                    rows = []

    return run


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return bisect_left(range(n), True, key=lambda k: a[: k + 1] != b[: k + 1])


def prefix_intervals(depths: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of the common-prefix intervals of an array.

    depths[i] is the common prefix of the members i and i + 1. Children come before parents.
    """
    stack: list[tuple[int, int]] = []
    for i, d in enumerate([*depths, -1]):
        left = i
        while stack and stack[-1][0] > d:
            depth, left = stack.pop()
            yield depth, left, i
        if d >= 0 and (not stack or stack[-1][0] < d):
            stack.append((d, left))


def maximal_repeats(before: list[bytes], after: list[bytes], least: int) -> Iterator[tuple[int, int, list[int]]]:
    """(left, right, members): the members share `left` bytes before and `right` after.

    before holds the reversed bytes to the left. Only repeats of `least` bytes and more come.
    """
    order = sorted(range(len(after)), key=after.__getitem__)
    depths = [common_prefix(after[a], after[b]) for a, b in zip(order, order[1:], strict=False)]
    for depth, first, last in prefix_intervals(depths):
        need = least - depth
        members = sorted(order[first : last + 1], key=before.__getitem__)
        shared = [common_prefix(before[a], before[b]) for a, b in zip(members, members[1:], strict=False)]
        if max(shared) < need:
            continue
        for left, a, b in prefix_intervals(shared):
            if left >= max(need, 0):
                yield left, depth, members[a : b + 1]


def _repeat_rows(least: int):
    """(id, start, end): of each group's members what is covered by repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .ngram_join import _runs

        for table in _runs(batches, "anchor"):
            keys = table.column("anchor").to_numpy()
            ids, places = table.column("id").to_pylist(), table.column("place").to_pylist()
            before, after = table.column("before").to_pylist(), table.column("after").to_pylist()
            start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).tolist()
            out: list[tuple[int, int, int]] = []
            for a, b in zip(start, [*start[1:], len(keys)], strict=True):
                at = list({(ids[i], places[i]): i for i in range(a, b)}.values())
                if len(at) < 2:
                    continue
                left, right = [-1] * len(at), [0] * len(at)
                for l, r, members in maximal_repeats([before[i] for i in at], [after[i] for i in at], least):
                    for m in members:
                        left[m], right[m] = max(left[m], l), max(right[m], r)
                out += [(ids[i], places[i] - left[m], places[i] + right[m]) for m, i in enumerate(at) if left[m] >= 0]
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id", "start", "end"])

    return run


def _split_spans(contexts: DataFrame, least: int, size: int, group_rows: int) -> DataFrame:
    """(id, start, end) of what repeats cover around the anchors of large groups.

    contexts has (anchor, id, place, before, after). A window that begins s bytes before the anchor
    shares with an equal one s bytes to the left and least - s to the right. For a band of s two such
    members agree in its core, the bytes that all its windows hold, so a group falls into smaller ones
    by cores. Members that agree in all bytes of the band are repeats of each other as far as the
    band reaches, and one of them stays for the others. A group that is still large is split by
    narrower bands; in a band of one s the core is the window, and nothing is left to compare.
    """
    spark = contexts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = width = least - size + 1
    level, spans = _table(contexts.withColumn("low", F.lit(0)), "contexts"), []
    while True:
        high = F.least(F.col("low") + width, F.lit(whole))
        rows = level.withColumn("high", high).withColumn("n_left", F.least(F.octet_length("before"), F.col("high") - 1))
        rows = rows.withColumn("n_right", F.least(F.octet_length("after"), least - F.col("low"))).where(f"greatest(low, {least} - n_right) <= n_left")
        bytes_of = lambda c, n: F.expr(f"substring({c}, 1, {n})")
        name = F.encode(F.concat_ws(",", "n_left", "n_right"), "UTF-8")
        rows = rows.select(
            "anchor", "low", "id", "place", "n_left", "n_right", bytes_of("before", "n_left").alias("before"), bytes_of("after", "n_right").alias("after"),
            F.sha2(F.concat(bytes_of("before", "low"), bytes_of("after", f"{least} - high + 1")), 256).alias("core"),
            F.sha2(F.concat(name, bytes_of("before", "n_left"), bytes_of("after", "n_right")), 256).alias("content"),
        )
        keys = ["anchor", "low", "core"]
        one = F.min(F.struct("id", "place", "before", "after")).alias("one")
        classes = _table(rows.groupBy(*keys, "content").agg(F.count("*").alias("n"), one), "classes")
        copied = classes.where("n > 1").select("anchor", "low", "content")
        spans.append(rows.join(copied, ["anchor", "low", "content"]).select("id", (F.col("place") - F.col("n_left")).alias("start"), (F.col("place") + F.col("n_right")).alias("end")))
        groups = cut(classes.groupBy(*keys).agg(F.count("*").alias("k")).where("k > 1"))
        members = classes.join(groups, keys).select("anchor", "low", "core", "k", "one.*")
        few = members.where(f"k <= {group_rows}").select(F.xxhash64("anchor", "low", "core").alias("anchor"), "id", "place", "before", "after")
        spans.append(few.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_repeat_rows(least), "id long, start long, end long"))
        if width == 1 or not groups.where(F.col("k") > group_rows).limit(1).count():
            break
        step = -(-width // BANDS)
        lows = F.explode(F.sequence(F.col("low"), F.least(F.col("low") + width, F.lit(whole)) - 1, F.lit(step))).alias("low")
        level = _table(members.where(f"k > {group_rows}").select("anchor", lows, "id", "place", "before", "after"), "contexts")
        width = step
    out = spans[0]
    for more in spans[1:]:
        out = out.union(more)
    return out


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n_removed, n_spans, kept_sha256) of texts and their spans."""
    for batch in batches:
        raw, offsets = utf8_of(batch.column(1))
        out = []
        for r, spans in enumerate(batch.column(2).to_pylist()):
            text = raw[offsets[r] : offsets[r + 1]].tobytes()
            runs: list[list[int]] = []
            for a, b in sorted((x["start"], x["end"]) for x in spans):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            kept, at = hashlib.sha256(), 0
            for a, b in runs:
                kept.update(text[at:a])
                at = b
            kept.update(text[at:])
            out.append((sum(b - a for a, b in runs), len(runs), kept.hexdigest()))
        cols = list(zip(*out, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["id", "n_removed", "n_spans", "kept_sha256"]
        )


def repeat_spans(texts: DataFrame, heads: DataFrame, least: int = LEAST, anchor: int = ANCHOR, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame]:
    """Of the texts (id, text) that heads names: (id, text) of those that may hold repeats, and
    (id, start, end) of what repeats cover; the spans may overlap."""
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = "id long, anchors array<long>, places array<int>, runs array<struct<start:long,end:long>>"
    dealt = cut(texts.mapInArrow(_anchor_rows(least, anchor), kinds).where("size(anchors) > 0").join(heads, "id", "left_semi"))
    found = dealt.select("id", F.inline(F.arrays_zip("anchors", "places"))).toDF("id", "anchor", "place")
    often = cut(found.groupBy("anchor").agg(F.count("*").alias("members")).where("members > 1"))
    marks = found.join(often, "anchor").groupBy("id").agg(F.collect_list(F.struct("place", "anchor", "members")).alias("marks"))
    alone = dealt.where("size(runs) > 0").select("id", "runs")
    marks = marks.join(alone, "id", "full").withColumn("marks", F.coalesce("marks", F.array().cast("array<struct<place:int,anchor:long,members:long>>")))
    marked = _table(texts.join(marks, "id").dropDuplicates(["id"]), "marked")

    kinds = "anchor long, members long, id long, place int, before binary, after binary"
    of = lambda rule: marked.select("id", "text", F.filter("marks", rule).alias("marks")).where("size(marks) > 0").mapInArrow(_contexts(least, anchor), kinds)
    few = of(lambda m: m["members"] <= group_rows).repartition(parts, "anchor").sortWithinPartitions("anchor")
    spans = few.mapInArrow(_repeat_rows(least), "id long, start long, end long")
    spans = spans.union(marked.where("runs is not null").select("id", F.inline("runs")))
    if often.where(F.col("members") > group_rows).limit(1).count():
        large = of(lambda m: m["members"] > group_rows).drop("members")
        spans = spans.union(_split_spans(large, least, anchor, group_rows))
    return marked.select("id", "text"), spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, anchor: int = ANCHOR, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, repeats), one row for each row of docs.

    repeats says whether anything is removed. Removed is each UTF-8 byte that a `least`-byte string covers which also starts elsewhere,
    in the same text or another. Null texts are empty; texts shorter than `least` lose nothing.
    Whole texts that occur twice lose everything, every copy. id_col must be a long that is
    different for each row; identical rows under one id count as copies of each other. Rows
    with a null id get the result of their text if it is a copy of another, and otherwise
    count only as themselves with nothing removed. An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = cut(texts.select("id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes")))
    classes = cut(own.groupBy("sha").agg(F.min("id").alias("head"), F.count("*").alias("copies"), F.max("n_bytes").alias("size")))
    heads = classes.where(f"size >= {least} and head is not null").select(F.col("head").alias("id"))
    marked, spans = repeat_spans(texts, heads, least, anchor, group_rows)
    spans = spans.groupBy("id").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    done = marked.join(spans, "id").mapInArrow(_without, "id long, n_removed long, n_spans long, kept_sha256 string")
    copied = classes.where(f"copies > 1 and size >= {least}").select("sha", F.lit(True).alias("copied"))
    out = own.join(copied, "sha", "left").join(done, "id", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    whole = F.coalesce("copied", F.lit(False))
    return out.select(
        "id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        (whole | (F.coalesce("n_removed", F.lit(0)) > 0)).alias("repeats"),
    )
