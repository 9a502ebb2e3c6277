"""Event streams: validated transitions, message deduplication, chat sessions, stale events.

The same functions take static and streaming frames where Spark allows it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.lifecycle import TRANSITIONS, unread_pages


def deduplicated(messages: DataFrame, key: str = "message_uuid", at: str = "ts", ttl: str = "1 hour") -> DataFrame:
    """Messages without repeats within ttl; the state of a key is dropped once the watermark has passed it."""
    return messages.withWatermark(at, ttl).dropDuplicatesWithinWatermark([key])


def fresh(messages: DataFrame, at: str = "ts", now: str = "received_at", most_seconds: int = 3600) -> DataFrame:
    """Messages made within most_seconds of when they were received, before or after: replays are refused, and so are clocks that far ahead."""
    return messages.where(F.abs(F.unix_timestamp(now) - F.unix_timestamp(at)) <= most_seconds)


def session_counts(messages: DataFrame, key: str, at: str = "ts", gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """key, begin, end, n of each session window."""
    rows = messages.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("s")).agg(F.count("*").alias("n"))
    return rows.select(key, F.col("s.start").alias("begin"), F.col("s.end").alias("end"), "n")


class Lifecycle(StatefulProcessor):
    """Keeps each record's state; events that may not follow it come out as illegal and change nothing."""

    def __init__(self, transitions: Mapping[str, Sequence[str]] = TRANSITIONS):
        self.transitions = {k: list(v) for k, v in transitions.items()}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "value string")

    def handleInputRows(self, key, rows, timerValues):
        now = self.state.get()[0] if self.state.exists() else None
        events = pd.concat(list(rows)).sort_values("event_id")
        out = []
        for event_id, new in zip(events["event_id"], events["state"], strict=True):
            ok = now is None or new in self.transitions.get(now, [])
            out.append((key[0], int(event_id), now, new, ok))
            now = new if ok else now
        self.state.update((now,))
        yield pd.DataFrame(out, columns=["record_id", "event_id", "from_state", "to_state", "legal"])

    def close(self) -> None:
        pass


def validated(events: DataFrame, transitions: Mapping[str, Sequence[str]] = TRANSITIONS) -> DataFrame:
    """record_id, event_id, from_state, to_state, legal of a stream of record_id, event_id, state.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    schema = "record_id string, event_id long, from_state string, to_state string, legal boolean"
    return events.groupBy("record_id").transformWithStateInPandas(statefulProcessor=Lifecycle(transitions), outputStructType=schema, outputMode="Append", timeMode="None")


def read_as_they_come(pages: DataFrame, read: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Starts a query that reads the pages of a stream, each once, and keeps the readings as Parquet in folders of batches.

    read: pages to readings, which carry page_id. After a stop the stream goes
    on where it was; a batch that runs again replaces its own folder, so no
    reading is kept twice, and pages read in earlier batches aren't read again.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(["page_id"])
        if number > 0:  # the first batch always leaves its folder
            new = unread_pages(new, spark.read.parquet(path).where(F.col("batch") < number))
        read(new).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return pages.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
