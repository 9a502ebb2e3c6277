"""Substring deduplication with fixed-block anchors.

Texts are sequences of words. Every text is cut into non-overlapping blocks of
``(window + 1) // 2`` words; any window of ``window`` words holds at least one
whole block of its own text. The blocks are the index, every rolling window of
that many words is a probe. A block that is probed from two places or more is
a hit, and the hits are extended: each window around a hit block is compared
by a 128-bit hash with all others, and the union of the windows that occur
elsewhere is exactly the union of the maximal repeats of ``window`` words or
more. Probes carry no position and travel as sorted differences, three bytes
each; both sides of a hash meet in one task of bounded size.

Edge cases: null and empty texts have no words; a text shorter than the window
loses nothing; a text that occurs twice loses all its words; ids may be null or
repeat, rows are judged by text; other columns are ignored.
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

WINDOW = 35


class Words:
    """Word hashes and window hashes of a piece."""

    def __init__(self):
        self.a, self.b, self.of_bytes = tx.Rolling(tx.BASE_A), tx.Rolling(tx.BASE_B), tx.Rolling(0xA0761D6478BD642F)
        self.values = tx.byte_values()

    def read(self, data, off):
        s, e, woff = tx.words(data, off, tx.BLANK_WORDS)
        h = self.of_bytes.span(self.of_bytes.prefix(self.values[data]), s, e)
        return s, e, woff, h


def key_bits(n: int) -> int:
    """Bits of a probe's key: they grow with the number of buckets, as that does with the input."""
    return min(56, 36 + n.bit_length())


def index_and_probes(n: int, block: int):
    """Packed rows: sorted probes of each bucket, and the blocks with their places."""
    drop = tx.U64(64 - key_bits(n))

    def run(batches):
        words = Words()
        for batch in batches:
            ids, probes, held = rp.keyed(batch), [], []
            for row, _, data, off in tx.pieces(batch.column("text")):
                _, _, woff, h = words.read(data, off)
                sizes = np.diff(woff)
                end = np.repeat(woff[1:], sizes)
                at = np.arange(len(h))
                at = at[at + block <= end]
                if not len(at):
                    continue
                keys = words.a.span(words.a.prefix(h), at, at + block)
                probes.append(keys)
                doc = np.searchsorted(woff, at, "right") - 1
                within = at - woff[doc]
                whole = within % block == 0
                held.append((keys[whole], doc[whole] + row, within[whole] // block))
            if not probes:
                continue
            p = np.sort(np.concatenate(probes))
            few = np.ones(len(p), bool)
            few[2:] = p[2:] != p[:-2]  # twice is as good as often
            p = p[few]
            keys, doc, at = map(np.concatenate, zip(*held, strict=True))
            packed = list(rp.combined(n, n, ids, doc, keys, np.zeros(len(keys), np.uint64), at))
            bounds = tx.run_bounds(b := tx.bucket_of(p, n))
            rows = [(int(b[lo]), tx.pack(np.diff(p[lo:hi] >> drop, prepend=tx.U64(0)))) for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            none = [b""] * len(rows)
            yield from packed
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in rows], pa.int32()), "ids": none, "first": none, "second": none, "at": none, "extra": [r[1] for r in rows]}, schema=packed[-1].schema)

    return run


def blocks_hit(n: int):
    drop = tx.U64(64 - key_bits(n))

    def run(batches):
        probes, blocks, passed = [], [], []
        for batch in batches:
            for bucket, ids, first, at, extra in zip(*(batch.column(k).to_pylist() for k in ("bucket", "ids", "first", "at", "extra")), strict=True):
                if ids and not first:  # hits that were found on the other side already
                    passed.append((bucket, ids, at))
                elif ids:
                    runs = np.frombuffer(ids, "<i8").reshape(-1, 3)
                    blocks.append((np.repeat(runs[:, :2], runs[:, 2], 0), tx.unpack(first) >> drop, tx.unpack(at).astype(np.int64)))
                else:
                    probes.append(np.cumsum(tx.unpack(extra), dtype=np.uint64))
        if passed:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*passed, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "ids", "at"])
        if not blocks:
            return
        p = np.sort(np.concatenate(probes))
        often = np.unique(p[1:][p[1:] == p[:-1]])
        ids, keys, at = map(np.concatenate, zip(*blocks, strict=True))
        if len(often):
            hit = often[np.minimum(np.searchsorted(often, keys), len(often) - 1)] == keys
            if hit.any():
                yield rp.home_rows(n, ids[hit], at[hit])

    return run


def windows_at_hits(n: int, homes: int, window: int, block: int):
    """Packed 128-bit hashes of every window whose first whole block is hit."""

    def run(batches):
        words = Words()
        for batch in batches:
            ids, out = rp.keyed(batch), []
            hits = batch.column("blocks")
            for row, rows, data, off in tx.pieces(batch.column("text")):
                _, _, woff, h = words.read(data, off)
                starts = []
                for d in range(rows):
                    n_words = int(woff[d + 1] - woff[d])
                    b = np.unique(rp.numbers(hits, row + d))
                    s = (b[:, None] * block - np.arange(block)).ravel()
                    starts.append(np.sort(s[(s >= 0) & (s <= n_words - window)]))
                size = [len(x) for x in starts]
                if not sum(size):
                    continue
                doc = np.repeat(np.arange(rows), size)
                at = np.concatenate(starts)
                lo = at + woff[doc]
                out.append((doc + row, words.a.span(words.a.prefix(h), lo, lo + window), words.b.span(words.b.prefix(h), lo, lo + window), at))
            if out:
                yield from rp.combined(n, homes, ids, *map(np.concatenate, zip(*out, strict=True)))

    return run


REMOVED = "t1 long, t2 long, words long, removed long, sha string, spans array<struct<begin:int,end:int>>"


def digest(parts) -> str:
    return hashlib.sha256(b" ".join(parts)).hexdigest()


def removed(window: int):
    """What is left of each text once the windows at ``starts`` are gone."""

    def run(batches):
        words = Words()
        for batch in batches:
            found, starts = [], batch.column("starts")
            copies = np.asarray(batch.column("copies"))
            for row, rows, data, off in tx.pieces(batch.column("text")):
                s, e, woff, _ = words.read(data, off)
                for d in range(rows):
                    lo, hi = int(woff[d]), int(woff[d + 1])
                    gone = np.full(hi - lo, copies[row + d] > 1 and hi - lo >= window)
                    gone |= tx.covered(rp.numbers(starts, row + d), window, hi - lo)
                    edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                    kept = np.flatnonzero(~gone) + lo
                    sha = digest([data[a:b].tobytes() for a, b in zip(s[kept].tolist(), e[kept].tolist(), strict=True)])
                    found.append((hi - lo, int(gone.sum()), sha, [{"begin": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]))
            cols = list(zip(*found, strict=True)) or [[]] * 4
            spans = pa.array(cols[3], pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_pydict({"t1": batch.column("t1"), "t2": batch.column("t2"), "words": pa.array(cols[0], pa.int64()), "removed": pa.array(cols[1], pa.int64()), "sha": pa.array(cols[2], pa.string()), "spans": spans})

    return run


def whole(batches):
    """doc_id, t1, t2, n_words and the digest of all words."""
    words = Words()
    for batch in batches:
        found = []
        for _, rows, data, off in tx.pieces(batch.column("text")):
            s, e, woff, _ = words.read(data, off)
            s, e, woff = s.tolist(), e.tolist(), woff.tolist()
            held = data.tobytes()
            found += [(woff[d + 1] - woff[d], digest([held[a:b] for a, b in zip(s[woff[d] : woff[d + 1]], e[woff[d] : woff[d + 1]], strict=True)])) for d in range(rows)]
        n, sha = zip(*found, strict=True) if found else ([], [])
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "t1": batch.column("t1"), "t2": batch.column("t2"), "n_words": pa.array(n, pa.int64()), "sha_all": pa.array(sha, pa.string())})


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """t1, t2, words, removed, sha, spans of every distinct text that loses something (and of some that don't)."""
    spark, block = docs.sparkSession, (window + 1) // 2
    n = buckets(spark)
    texts = docs.select(*rp.text_keys(), "text")
    hits = settled(texts.mapInArrow(index_and_probes(n, block), rp.PACKED).repartition("bucket").mapInArrow(blocks_hit(n), rp.HOME))
    held = rp.with_hits(docs, hits, "blocks")
    starts = held.select("t1", "t2", "text", "blocks").mapInArrow(windows_at_hits(n // 2, n, window, block), rp.PACKED).repartition("bucket").mapInArrow(rp.windows_that_repeat(n), rp.HOME)
    return held.select("t1", "t2", "text", "copies").join(rp.gathered(starts, "starts"), ["t1", "t2"], "left").mapInArrow(removed(window), REMOVED)


def report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    kind = dict(docs.dtypes)["doc_id"]
    every = docs.select("doc_id", *rp.text_keys(), "text").mapInArrow(whole, f"doc_id {kind}, t1 long, t2 long, n_words long, sha_all string")
    return every.join(settled(repeats(docs, window).drop("spans")), ["t1", "t2"], "left").select(
        "doc_id", "n_words", F.coalesce("removed", F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("sha", "sha_all").alias("kept_sha256"))
