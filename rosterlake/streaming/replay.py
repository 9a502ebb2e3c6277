"""Events of a key taken one after the other: the same step over a table and over a stream.

A step takes what is kept of its key and one event (a dictionary), changes what
is kept and returns a row. Keys are independent; the events of one key follow
each other by nature, so a key is one task's work, but never more in memory than
one batch of its events and what is kept of it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def _plain(value):
    """None for missing values, whole numbers as such, lists for arrays."""
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, list | tuple):
        return [_plain(x) for x in value]
    return None if value is None or value != value or value is pd.NaT else int(value) if isinstance(value, float) and value.is_integer() else value


def _rows(frame: pd.DataFrame) -> list[dict]:
    return [{k: _plain(v) for k, v in row.items()} for row in frame.to_dict("records")]


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def in_order(events: DataFrame, key: str, order: list[str], begin: Callable, step: Callable, schema: str) -> DataFrame:
    """A row (of this schema) for each event of a table; rows without a key are left out. begin: makes what is kept of a new key."""

    def run(frames: Iterator[pd.DataFrame]):
        of, held = None, None
        for frame in frames:
            out = []
            for event in _rows(frame):
                if event[key] != of:
                    of, held = event[key], begin()
                out.append(step(held, event))
            yield _frame(out, schema)

    return events.where(events[key].isNotNull()).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


class Follower(StatefulProcessor):
    """Keeps what is held of each key, a dataclass, as JSON between the batches of a stream."""

    def __init__(self, order: list[str], begin: Callable, step: Callable, schema: str):
        self.order, self.begin, self.step, self.schema = order, begin, step, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "kept string")

    def handleInputRows(self, key, rows, timerValues):
        held = self.begin(**json.loads(self.kept.get()[0])) if self.kept.exists() else self.begin()
        new = pd.concat(list(rows)).sort_values(self.order)
        out = [self.step(held, event) for event in _rows(new)]
        self.kept.update((json.dumps(asdict(held)),))
        yield _frame(out, self.schema)

    def close(self) -> None:
        pass


def as_they_come(events: DataFrame, key: str, order: list[str], begin: Callable, step: Callable, schema: str) -> DataFrame:
    """in_order() of a stream, each batch in order. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    follower = Follower(order, begin, step, schema)
    return events.where(events[key].isNotNull()).groupBy(key).transformWithStateInPandas(statefulProcessor=follower, outputStructType=schema, outputMode="Append", timeMode="None")
