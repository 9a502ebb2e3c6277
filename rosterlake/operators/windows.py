"""Ordered analytics over entities: neighbours, orders, merges, runs and sessions."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _over(entity: Sequence[str], order: Sequence):
    return Window.partitionBy(*entity).orderBy(*order)


def spikes(df: DataFrame, entity: Sequence[str], order: Sequence, value: str, tolerance: float) -> DataFrame:
    """The rows far from both neighbours that have a value, on the same side; before and after come along."""
    w = _over(entity, order)
    b, a, c = F.col(value), F.col("before_value"), F.col("after_value")
    near = df.where(b.isNotNull()).withColumn("before_value", F.lag(value).over(w)).withColumn("after_value", F.lead(value).over(w))
    return near.where(((b - a) * (b - c) > 0) & (F.least(F.abs(b - a), F.abs(b - c)) > tolerance))


def order_violations(df: DataFrame, entity: Sequence[str], order: Sequence, at: str) -> DataFrame:
    """Rows of dated entities with previous, violates (not after it) and doubtful (violates, or the next one does)."""
    w = _over(entity, order)
    rows = df.where(F.col(at).isNotNull()).withColumn("previous", F.lag(at).over(w)).withColumn("violates", F.coalesce(F.col(at) <= F.col("previous"), F.lit(False)))
    return rows.withColumn("doubtful", F.col("violates") | F.coalesce(F.lead("violates").over(w), F.lit(False)))


def delta_vs_elapsed(df: DataFrame, entity: Sequence[str], order: Sequence, value: str, at_days: Column, per_days: float, tolerance: float) -> DataFrame:
    """Rows whose value grew by more or less than the time since the previous row allows."""
    w = _over(entity, order)
    rows = df.withColumn("__d", at_days).withColumn("previous", F.lag(value).over(w)).withColumn("elapsed", (F.col("__d") - F.lag("__d").over(w)) / per_days)
    return rows.where(F.abs(F.col(value) - F.col("previous") - F.col("elapsed")) > tolerance).drop("__d")


def newest_of_same_key(df: DataFrame, key: Sequence[str], newest: Sequence) -> DataFrame:
    """One row for each key: the first in the given order (put the newest first)."""
    return df.withColumn("__r", F.row_number().over(_over(key, newest))).where("__r = 1").drop("__r")


def first_last_change(df: DataFrame, entity: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """entity..., change (last minus first), of entities with two values or more; one aggregation, no sort."""
    s = F.struct(*order)
    agg = df.where(F.col(value).isNotNull()).groupBy(*entity).agg(F.count("*").alias("n_points"), F.max_by(value, s).alias("l"), F.min_by(value, s).alias("f"))
    return agg.where("n_points > 1").select(*entity, "n_points", (F.col("l") - F.col("f")).alias("change"))


def numbered_by_section(df: DataFrame, document: str | Sequence[str], section: str, ordinal: str) -> DataFrame:
    """number: place in the document (one key or several) when sections are kept together in the order of their first row."""
    keys = [document] if isinstance(document, str) else list(document)
    first = F.min(ordinal).over(Window.partitionBy(*keys, section))
    return df.withColumn("__f", first).withColumn("number", F.row_number().over(_over(keys, ["__f", section, ordinal]))).drop("__f")


def runs(df: DataFrame, entity: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """entity..., run (from 1), label, n_rows, first_at: consecutive rows of one label."""
    w = _over(entity, order)
    change = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    rows = df.withColumn("__c", change).withColumn("run", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*entity, "run", label).agg(F.count("*").alias("n_rows"), F.min(order[0]).alias("first_at"))


def sessions(df: DataFrame, entity: str, at_seconds: Column, gap: int, order: str) -> DataFrame:
    """entity, session (from 1), n, begin_s, end_s: a new session starts when the gap is exceeded, not when it is met."""
    w = Window.partitionBy(entity).orderBy("__t", order)
    rows = df.withColumn("__t", at_seconds)
    new = F.when(F.col("__t") - F.lag("__t").over(w) <= gap, 0).otherwise(1)
    rows = rows.withColumn("__n", new).withColumn("session", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(entity, "session").agg(F.count("*").alias("n"), F.min("__t").alias("begin_s"), F.max("__t").alias("end_s"))


def first_sightings(df: DataFrame, key: Sequence[str], at_seconds: Column, ttl: int, order: str) -> DataFrame:
    """The rows kept when a key is let through once in ttl seconds, counted from the last one let through.

    A refused row doesn't start the time anew, which no window frame can say: each
    partition's rows pass sorted by key and time, with the last sighting as state,
    so a key with any number of rows takes no memory.
    """
    rows = df.select(*key, at_seconds.alias("at_s"), F.col(order)).repartition(*key).sortWithinPartitions(*key, "at_s", order)

    def run(batches):
        now = last = None
        for batch in batches:
            keep = []
            names = zip(*(batch.column(k).to_pylist() for k in key), strict=True)
            for i, (name, t) in enumerate(zip(names, batch.column("at_s").to_pylist(), strict=True)):
                if name != now:
                    now, last = name, None
                if last is None or (t is not None and t - last > ttl):
                    last = t
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))

    return rows.mapInArrow(run, rows.schema)


def top_n(df: DataFrame, group: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """The first n rows of each group, with place; a top-k report. Spark cuts each partition to n before the shuffle."""
    return df.withColumn("place", F.row_number().over(_over(group, order))).where(F.col("place") <= n)
