"""What the two exact-repeat operators share: distinct texts, and rows of packed arrays dealt by hash.

Work is keyed by the text itself (two 64-bit hashes), not by document: copies
of a text are one row with a count, and ids may repeat or be null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from ._common import settled


def text_keys(text: str = "text"):
    whole = F.coalesce(F.col(text), F.lit(""))
    return F.xxhash64(whole).alias("t1"), F.xxhash64(F.lit(1), whole).alias("t2")


def distinct_texts(docs: DataFrame) -> DataFrame:
    """t1, t2, text, copies: one row for each different text, merged on the map side first."""
    return docs.select(*text_keys(), F.coalesce(F.col("text"), F.lit("")).alias("text")).groupBy("t1", "t2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))


def keyed(batch: pa.RecordBatch) -> np.ndarray:
    """Rows of t1, t2."""
    return np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in ("t1", "t2")], 1)


HITS = "t1 long, t2 long, at array<int>"
HOME = "bucket int, ids binary, at binary"
PACKED = "bucket int, ids binary, first binary, second binary, at binary, extra binary"


def packed_rows(n: int, ids: np.ndarray, row: np.ndarray, first: np.ndarray, second: np.ndarray, at: np.ndarray):
    """One row for each bucket of ``first``: its keys, positions, and the texts they are of (by run)."""
    out = {k: [] for k in ("bucket", "ids", "first", "second", "at", "extra")}
    order, parts = tx.by_bucket(first, n)
    for b, part in parts:
        mine = order[part]
        r = row[mine]  # ascending, for the order is stable
        bounds = tx.run_bounds(r)
        out["bucket"].append(b)
        out["ids"].append(tx.blob(np.c_[ids[r[bounds[:-1]]], np.diff(bounds)].astype("<i8")))
        out["first"].append(tx.pack(first[mine]))
        out["second"].append(tx.pack(second[mine]))
        out["at"].append(tx.pack(at[mine]))
        out["extra"].append(b"")
    return pa.RecordBatch.from_pydict({"bucket": pa.array(out["bucket"], pa.int32()), **{k: pa.array(out[k], pa.binary()) for k in ("ids", "first", "second", "at", "extra")}})


def combined(n: int, homes: int, ids: np.ndarray, row: np.ndarray, first: np.ndarray, second: np.ndarray, at: np.ndarray, known: np.ndarray | None = None):
    """packed_rows after a look within the batch: what repeats here is a repeat already, and one row of each stands for all elsewhere.

    So a hash that every document has puts a row for each batch into its bucket,
    not a row for each document. known: which rows may be told apart by their hash.
    """
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    if known is not None:
        new |= ~known[order]
    group = np.cumsum(new) - 1
    again, head = np.zeros(len(first), bool), np.zeros(len(first), bool)
    again[order], head[order] = np.bincount(group)[group] > 1, new
    if again.any():
        mine = home_rows(homes, ids[row[again]], at[again])
        none = pa.array([b""] * len(mine), pa.binary())
        yield pa.RecordBatch.from_arrays([mine.column("bucket"), mine.column("ids"), none, none, mine.column("at"), none], ["bucket", "ids", "first", "second", "at", "extra"])
    yield packed_rows(n, ids, row[head], first[head], second[head], at[head])


def unpacked(batches):
    """(all packed rows of a partition as (ids, first, second, at), or None; batches of home rows that only pass)."""
    got, passed = [], []
    for batch in batches:
        on = [i for i, f in enumerate(batch.column("first").to_pylist()) if not f]
        if on:
            passed.append(batch.select(["bucket", "ids", "at"]).take(pa.array(on)))
        for ids, first, second, at in zip(*(batch.column(k).to_pylist() for k in ("ids", "first", "second", "at")), strict=True):
            if first:
                runs = np.frombuffer(ids, "<i8").reshape(-1, 3)
                got.append((np.repeat(runs[:, :2], runs[:, 2], 0), tx.unpack(first), tx.unpack(second), tx.unpack(at).astype(np.int64)))
    return tuple(map(np.concatenate, zip(*got, strict=True))) if got else None, passed


def home_rows(n: int, ids: np.ndarray, at: np.ndarray, **more) -> pa.RecordBatch:
    """Positions packed by the home bucket of their text: few rows, however many texts there are."""
    order = np.lexsort((ids[:, 1], ids[:, 0], homes := tx.bucket_of(tx.mix(ids[:, 0].astype(np.uint64)), n)))
    ids, at, homes = ids[order], at[order], homes[order]
    bounds = tx.run_bounds(homes)
    out = {"bucket": [], "ids": [], "at": []}
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        k, off, (values,) = tx.grouped_rows(ids[lo:hi], at[lo:hi])
        out["bucket"].append(int(homes[lo]))
        out["ids"].append(tx.blob(np.c_[k, np.diff(off)].astype("<i8")))
        out["at"].append(tx.pack(values))
    rows = len(out["bucket"])
    return pa.RecordBatch.from_pydict({"bucket": pa.array(out["bucket"], pa.int32()), "ids": pa.array(out["ids"], pa.binary()), "at": pa.array(out["at"], pa.binary())} | {k: pa.array([v] * rows) for k, v in more.items()})


def at_home(batches):
    """One row for each text, with all its positions."""
    got = []
    for batch in batches:
        for ids, at in zip(batch.column("ids").to_pylist(), batch.column("at").to_pylist(), strict=True):
            runs = np.frombuffer(ids, "<i8").reshape(-1, 3)
            got.append((np.repeat(runs[:, :2], runs[:, 2], 0), tx.unpack(at).astype(np.int64)))
    if got:
        ids, at = map(np.concatenate, zip(*got, strict=True))
        k, off, (values,) = tx.grouped_rows(ids, at)
        step = 10_000
        for lo in range(0, len(k), step):
            o = off[lo : lo + step + 1]
            yield pa.RecordBatch.from_pydict({"t1": pa.array(k[lo : lo + step, 0], pa.int64()), "t2": pa.array(k[lo : lo + step, 1], pa.int64()), "at": tx.lists(values[o[0] : o[-1]].astype(np.int32), o - o[0])})


def windows_that_repeat(n: int):
    """The reducing side of packed windows: those whose 128-bit hash came twice or more."""

    def run(batches):
        got, passed = unpacked(batches)
        yield from passed
        if got is not None:
            ids, first, second, at = got
            again = tx.repeated(np.stack([first, second], 1))
            if again.any():
                yield home_rows(n, ids[again], at[again])

    return run


def gathered(hits: DataFrame, name: str) -> DataFrame:
    """t1, t2 and all positions of each text. hits: rows made by home_rows."""
    return hits.select("bucket", "ids", "at").repartition("bucket").mapInArrow(at_home, HITS).withColumnRenamed("at", name)


def with_hits(docs: DataFrame, hits: DataFrame, name: str) -> DataFrame:
    """The distinct texts that have hits, written to the shared folder."""
    return settled(distinct_texts(docs).join(gathered(hits, name), ["t1", "t2"]))


def numbers(column: pa.Array, row: int) -> np.ndarray:
    """A row of a list column; empty where it is null."""
    return np.asarray(column[row].values) if column[row].is_valid else np.zeros(0, np.int32)
