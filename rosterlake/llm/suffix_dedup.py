"""Suffix deduplication: byte strings of ``window`` bytes that occur elsewhere are removed.

Content-sampled anchors with hash-equal runs and windows, in place of external
induced sorting, which was not built: no suffixes are ordered and no common-prefix
lengths are kept. By an estimate, a tuple of five bytes or more for each byte of
text is more disk than the texts themselves. A content-defined sample of suffixes
is named, and windows round a sample suffix are compared in three levels:

1. The sample: of each window, the suffix whose first ``GRAM`` bytes have the
   least hash. Equal windows choose the same one. Names that occur once have a
   common prefix below ``GRAM`` with all others and are dropped, with every
   window that chose them.
2. The windows of a remaining sample suffix, in runs of ``RUN`` by their offset
   before it. A run whose hull (all its windows together) occurs elsewhere is
   repeated as a whole; one whose core (what all its windows share) occurs
   nowhere else is not repeated at all. Only a run between the two goes on,
   with one run of each repeated hull of the same core.
3. Those runs' windows, one by one.

Each level is dealt by hash over Spark's exchanges, which spill to disk; hulls
and windows are compared by 128-bit hashes.

Edge cases: null and empty texts have no bytes; a text shorter than the window
loses nothing; a text that occurs twice loses all; ids may be null or repeat,
rows are judged by text; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _repeats as rp
from . import textops as tx
from ._common import buckets, settled

WINDOW = 400
GRAM = 128
RUN = 32
#: Positions in a piece take this many of the 64 bits that sample suffixes are chosen by.
PLACE_BITS = 28


class Bytes:
    def __init__(self):
        self.a, self.b, self.values = tx.Rolling(tx.BASE_A), tx.Rolling(tx.BASE_B), tx.byte_values(3)

    def prefixes(self, data):
        v = self.values[data]
        return self.a.prefix(v), self.b.prefix(v)


def least_in_reach(values: np.ndarray, reach: int) -> np.ndarray:
    """The minimum of each ``reach`` consecutive values."""
    n = len(values)
    padded = np.full(-(-n // reach) * reach, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(-1, reach)
    after = np.minimum.accumulate(grid, 1).ravel()
    before = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(before[: n - reach + 1], after[reach - 1 : n])


def sample(prefix: np.ndarray, rolling: tx.Rolling, off: np.ndarray, window: int, gram: int):
    """(places in the piece, keys, documents, first and last window) of a piece's sample suffixes."""
    n = int(off[-1])
    if n < window:
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z, z, z
    at = np.arange(n - gram + 1)
    keys = rolling.span(prefix, at, at + gram)
    mask = tx.U64((1 << PLACE_BITS) - 1)
    least = least_in_reach((keys & ~mask) | at.astype(np.uint64), window - gram + 1)
    size = np.diff(off)
    some = size >= window
    count = np.where(some, size - window + 1, 0)
    starts = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(off[:-1], count)
    place = (least[starts] & mask).astype(np.int64)
    doc = np.repeat(np.arange(len(size)), count)
    bounds = tx.run_bounds(place)  # a place is chosen by neighbouring windows of one document
    first, last = bounds[:-1], bounds[1:] - 1
    return place[first], keys[place[first]], doc[first], starts[first], starts[last]


def sampled(n: int, window: int, gram: int):
    def run(batches):
        look = Bytes()
        for batch in batches:
            ids, out = rp.keyed(batch), []
            for row, _, data, off in tx.pieces(batch.column("text")):
                prefix = look.a.prefix(look.values[data])
                place, keys, doc, _, _ = sample(prefix, look.a, off, window, gram)
                out.append((doc + row, keys, place - off[doc]))
            if out:
                doc, keys, at = map(np.concatenate, zip(*out, strict=True))
                yield from rp.combined(n, n, ids, doc, keys, np.zeros(len(keys), np.uint64), at)

    return run


def names_that_repeat(n: int):
    def run(batches):
        got, passed = rp.unpacked(batches)
        yield from passed
        if got is not None:
            ids, keys, _, at = got
            again = tx.repeated(keys)
            if again.any():
                yield rp.home_rows(n, ids[again], at[again])

    return run


def runs(n: int, homes: int, window: int, gram: int, run_size: int):
    """Packed rows of the runs of windows before each repeated sample suffix: core, hull, where the run begins."""
    core_size = window - run_size + 1

    def run(batches):
        look = Bytes()
        for batch in batches:
            ids, out, hits = rp.keyed(batch), [], batch.column("names")
            for row, rows, data, off in tx.pieces(batch.column("text")):
                pa_, pb = look.prefixes(data)
                place, _, doc, first, last = sample(pa_, look.a, off, window, gram)
                if not len(place):
                    continue
                wanted = np.concatenate([rp.numbers(hits, row + d) + off[d] for d in range(rows)]) if rows else np.zeros(0)
                mine = np.isin(place, wanted)
                place, doc, first, last = place[mine], doc[mine], first[mine], last[mine]
                lo, hi = (place - last) // run_size, (place - first) // run_size
                count = hi - lo + 1
                which = np.repeat(np.arange(len(place)), count)
                j = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + lo[which]
                doc, end = doc[which], place[which] - j * run_size  # the run's last window
                begin = end - run_size + 1
                whole = (begin >= off[doc]) & (end + window <= off[doc + 1])
                core = look.a.span(pa_, end, end + core_size)
                core = tx.mix(core + j.astype(np.uint64))  # the same core at another offset is another run
                hull = np.zeros(len(which), np.uint64)
                hull[whole] = look.b.span(pb, begin[whole], end[whole] + window) ^ tx.mix(look.a.span(pa_, begin[whole], end[whole] + window))
                out.append((doc + row, core, hull, begin - off[doc] + run_size))
            if out:
                doc, core, hull, at = map(np.concatenate, zip(*out, strict=True))
                yield from rp.combined(n, homes, ids, doc, core, hull, at, known=hull != 0)

    return run


RUNS = rp.HOME + ", whole boolean"


def judged_runs(n: int):
    """Runs that are repeated as a whole, and those whose windows must be looked at."""

    def run(batches):
        got, passed = rp.unpacked(batches)
        for batch in passed:
            yield batch.append_column("whole", pa.array([True] * len(batch)))
        if got is None:
            return
        ids, core, hull, at = got
        some = tx.repeated(core)
        ids, core, hull, at = ids[some], core[some], hull[some], at[some]
        if not len(core):
            return
        known = hull != 0
        again = tx.repeated(np.stack([core, hull], 1)) & known
        order = np.lexsort((hull, core))
        c, h, k = core[order], hull[order], known[order]
        new_core = np.r_[True, c[1:] != c[:-1]]
        new_class = new_core | np.r_[True, h[1:] != h[:-1]] | ~k
        group = np.cumsum(new_core) - 1
        classes = np.bincount(group, new_class)
        look = np.zeros(len(core), bool)
        look[order] = new_class & (classes[group] > 1)
        for mine, whole in ((again, True), (look, False)):
            if mine.any():
                yield rp.home_rows(n, ids[mine], at[mine], whole=whole)

    return run


def windows_in_runs(n: int, homes: int, window: int, run_size: int):
    def run(batches):
        look = Bytes()
        for batch in batches:
            ids, out, hits = rp.keyed(batch), [], batch.column("look")
            for row, rows, data, off in tx.pieces(batch.column("text")):
                starts, size = [], []
                for d in range(rows):
                    s = (np.unique(rp.numbers(hits, row + d))[:, None] - run_size + np.arange(run_size)).ravel()
                    s = np.unique(s[(s >= 0) & (s <= off[d + 1] - off[d] - window)])
                    starts.append(s)
                    size.append(len(s))
                if not sum(size):
                    continue
                pa_, pb = look.prefixes(data)
                doc, at = np.repeat(np.arange(rows), size), np.concatenate(starts)
                lo = at + off[doc]
                out.append((doc + row, look.a.span(pa_, lo, lo + window), look.b.span(pb, lo, lo + window), at))
            if out:
                yield from rp.combined(n, homes, ids, *map(np.concatenate, zip(*out, strict=True)))

    return run


REMOVED = "t1 long, t2 long, removed long, sha string, spans array<struct<begin:int,end:int>>"


def left_over(window: int, run_size: int):
    def run(batches):
        for batch in batches:
            found, whole, single, copies = [], batch.column("whole"), batch.column("single"), np.asarray(batch.column("copies"))
            for row, rows, data, off in tx.pieces(batch.column("text")):
                for d in range(rows):
                    text = data[off[d] : off[d + 1]]
                    gone = np.full(len(text), copies[row + d] > 1 and len(text) >= window)
                    gone |= tx.covered(rp.numbers(whole, row + d).astype(np.int64) - run_size, window + run_size - 1, len(text))
                    gone |= tx.covered(rp.numbers(single, row + d).astype(np.int64), window, len(text))
                    edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).reshape(-1, 2)
                    found.append((int(gone.sum()), hashlib.sha256(text[~gone].tobytes()).hexdigest(), [{"begin": int(a), "end": int(b)} for a, b in edge]))
            cols = list(zip(*found, strict=True)) or [[]] * 3
            spans = pa.array(cols[2], pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_pydict({"t1": batch.column("t1"), "t2": batch.column("t2"), "removed": pa.array(cols[0], pa.int64()), "sha": pa.array(cols[1], pa.string()), "spans": spans})

    return run


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, run_size: int = RUN) -> DataFrame:
    """t1, t2, removed, sha, spans of every distinct text that loses something (and of some that don't)."""
    if not run_size <= window - gram:
        raise ValueError("window must be at least gram + run_size")
    n = buckets(docs.sparkSession)
    texts = docs.select(*rp.text_keys(), "text").where(F.octet_length("text") >= window)
    hits = settled(texts.mapInArrow(sampled(n, window, gram), rp.PACKED).repartition("bucket").mapInArrow(names_that_repeat(n), rp.HOME))
    held = rp.with_hits(docs.where(F.octet_length("text") >= window), hits, "names")
    judged = settled(held.select("t1", "t2", "text", "names").mapInArrow(runs(n // 2, n, window, gram, run_size), rp.PACKED).repartition("bucket").mapInArrow(judged_runs(n), RUNS))
    looked = held.select("t1", "t2", "text").join(rp.gathered(judged.where("not whole"), "look"), ["t1", "t2"])
    single = looked.mapInArrow(windows_in_runs(n // 2, n, window, run_size), rp.PACKED).repartition("bucket").mapInArrow(rp.windows_that_repeat(n), rp.HOME)
    found = rp.gathered(judged.where("whole"), "whole").join(rp.gathered(single, "single"), ["t1", "t2"], "full")
    return held.select("t1", "t2", "text", "copies").join(found, ["t1", "t2"], "left").mapInArrow(left_over(window, run_size), REMOVED)


def report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    text = F.coalesce(F.col("text"), F.lit(""))
    every = docs.select("doc_id", *rp.text_keys(), F.octet_length(text).cast("bigint").alias("n_bytes"), F.sha2(text, 256).alias("sha_all"))
    found = settled(repeats(docs, window).select("t1", "t2", "removed", "sha", F.size("spans").cast("bigint").alias("n")))
    return every.join(found, ["t1", "t2"], "left").select(
        "doc_id", "n_bytes", F.coalesce("removed", F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_spans"), F.coalesce("sha", "sha_all").alias("kept_sha256"))
