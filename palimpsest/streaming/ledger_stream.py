"""The ledger over a stream of log rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

VERSION_ROWS = "entity string, attribute string, seq long, value string, action string, version int, supersedes long"
_STATE = "version int, value string, seq long, live boolean"


def with_event_time(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks want a timestamp with a zone; tables hold it without one."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def distinct_events(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first of equal events within the watermark."""
    return with_event_time(events, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, by: str, ts: str = "ts", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events and their values by window and key; rows later than the watermark are dropped."""
    return with_event_time(events, ts).withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("window.start").alias("start"), by, "n", "total"
    )


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One key's rows, in the order of seq within a batch; batches are taken as they come."""
    version, value, seq, live = state.get if state.exists else (-1, None, None, False)
    rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
    out = []
    for r in rows.itertuples(index=False):
        before = None
        if r.op == "retract":
            action, own = "retract", None
            version, value, seq, live = -1, None, None, False
        elif live and r.value == value:
            action, own = "duplicate", version
        else:
            before = seq if live else None
            version, value, seq, live = version + 1 if live else 0, r.value, r.seq, True
            action, own = "updated" if version else "inserted", version
        out.append((*key, r.seq, r.value, action, own, before))
    state.update((version, value, seq, live))
    frame = pd.DataFrame(out, columns=["entity", "attribute", "seq", "value", "action", "version", "supersedes"])
    yield frame.astype({"version": "Int32", "supersedes": "Int64"})


def ledger_versions(log: DataFrame) -> DataFrame:
    """The actions of a streamed log (entity, attribute, seq, op, value), a row for each log row.

    State holds one active version for each key. Unlike the batch view, a row can't say that it
    will be superseded; the row that does names it. Within a batch a key's rows are taken in the
    order of seq; a row that comes in a later batch than one of a larger seq is folded after it, so
    the rows are those of the batch view only if batches come in the order of seq. A task holds one
    key's rows of one batch, which the source's rate bounds (maxFilesPerTrigger and the like).
    """
    return log.groupBy("entity", "attribute").applyInPandasWithState(_fold, VERSION_ROWS, _STATE, "append", GroupStateTimeout.NoTimeout)
