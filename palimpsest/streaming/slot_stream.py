"""The slot bank over a stream, one bank for each key in a state store."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import SLOT_ROWS, SlotBank, slot_log

#: The provider that stateful processors need, as a setting of the session.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Banks(StatefulProcessor):
    """State is the bank's slots, facts and count of writes: its size has the slots' bound and that of the key's facts."""

    def __init__(self, key: str, slots: int, score: Callable[[np.ndarray, np.ndarray], np.ndarray] | None) -> None:
        self.key, self.slots, self.score = key, slots, score

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bank", "bank binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        bank = SlotBank(self.slots, self.score)
        if self.state.exists():
            bank.held, bank.facts, bank.writes = pickle.loads(self.state.get()[0])  # written below
        # a batch's rows may come in any order; its frames are taken apart one by one, and rows kept small
        waiting = sorted((r for frame in rows for r in frame[["seq", "op", "tokens", "vector", "fact"]].itertuples(index=False, name=None)), key=lambda r: r[0])
        out = []
        for seq, op, tokens, vector, fact in waiting:
            action, slot, overlap, learned = bank.step(op, tokens if tokens is None else list(tokens), vector, fact if isinstance(fact, str) else None)
            out.append((key[0], seq, action, slot, overlap, learned))
        self.state.update((pickle.dumps((bank.held, bank.facts, bank.writes)),))
        frame = pd.DataFrame(out, columns=[self.key, "seq", "action", "slot", "overlap", "learned"])
        yield frame.astype({"slot": "Int32", "learned": "float64"})

    def close(self) -> None:
        pass


def slot_banks(log: DataFrame, slots: int = 16, score: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, key: str = "user_id") -> DataFrame:
    """folds.slot_bank over a stream: the same rows, if those of a later batch have a larger seq than all before.

    Within a batch rows are taken in the order of seq; a row that comes in a later batch than one of
    a larger seq is folded after it. The session must have STATE_STORE set. Rows without key are
    left out: a stream's groups have keys.
    """
    rows = slot_log(log, key).where(f"{key} is not null")
    return rows.groupBy(key).transformWithStateInPandas(_Banks(key, slots, score), f"{key} long, {SLOT_ROWS}", "Append", "None")
