"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of up to ``ORDER`` bytes is counted
over training texts and frozen. A byte's code length in a context that has seen
it is -log2(count / (total + kinds)), kinds being the number of different bytes
seen there; else the escape's, -log2(kinds / (total + kinds)), plus its code
length in the context one byte shorter, down to one in 256. A text's length is
the sum over all its bytes; the shortest wins, and its score is the posterior
under equal priors.

The code lengths of all languages are laid out by the contexts that any of them
holds, so a text is scored by table look-ups. Training texts are a bounded
sample, about ``TRAIN_BYTES`` a language, chosen by a hash. A-Z count as a-z.

Edge cases: a null text and one without a letter are ``und`` with score 0; rows
without lang teach nothing; without any training text all is ``und``; equal
lengths go to the first language by name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx

ORDER = 3
TRAIN_BYTES = 3 << 20
#: A context must have been followed this often in a language to be in its tree.
LEAST = 8


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def training(docs: DataFrame, train_bytes: int) -> dict[str, list[bytes]]:
    """Whole texts of a bounded sample of each language, without held-out rows."""
    rows = docs.where("lang is not null and text is not null").where(~held_out()).select("doc_id", "lang", "text")
    sizes = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size")).withColumn("limit", F.least(F.lit(1_000_000), F.ceil(1_000_000 * train_bytes / F.col("size"))))
    picked = rows.join(F.broadcast(sizes.select("lang", "limit")), "lang").where(F.pmod(F.xxhash64(F.lit(3), "doc_id", "text"), F.lit(1_000_000)) < F.col("limit"))
    out: dict[str, list[bytes]] = {}
    for r in picked.select("lang", "text").toLocalIterator():
        out.setdefault(r["lang"], []).append(r["text"].encode())
    return {k: sorted(out[k]) for k in sorted(out)}


def counted(texts: list[bytes], classes: np.ndarray, base: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: (context and byte as one number, count)."""
    out = []
    for order in range(ORDER + 1):
        keys = []
        for t in texts:
            c = classes[tx.LOWER[np.frombuffer(t, np.uint8)]].astype(np.int64)
            if len(c) > order:
                k = np.zeros(len(c) - order, np.int64)
                for i in range(order + 1):
                    k = k * base + c[i : len(c) - order + i]
                keys.append(k)
        out.append(np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    return out


class Model:
    """Frozen code lengths: ``state`` of the last three bytes' classes, ``bits`` by state and byte class."""

    def __init__(self, texts: dict[str, list[bytes]], least: int = LEAST):
        self.langs = list(texts)
        if not texts:
            return
        seen = np.zeros(256, bool)
        for t in texts.values():
            for x in t:
                seen[tx.LOWER[np.frombuffer(x, np.uint8)]] = True
        # class 0: before the text; 1: bytes that no training text holds
        self.classes = np.ones(256, np.int32)
        self.classes[seen] = np.arange(2, 2 + seen.sum())
        base = self.base = 2 + int(seen.sum())
        tables = [counted(t, self.classes, base) for t in texts.values()]
        trees = []  # for each language and order: contexts, totals, kinds
        for lang in tables:
            tree = []
            for order, (keys, n) in enumerate(lang):
                ctx, at = np.unique(keys // base, return_inverse=True)
                total, kinds = np.bincount(at, n, len(ctx)), np.bincount(at, minlength=len(ctx))
                keep = (total >= least) | (order == 0)
                tree.append((ctx[keep], total[keep], kinds[keep]))
            trees.append(tree)
        held = [np.unique(np.concatenate([t[k][0] for t in trees])) for k in range(ORDER + 1)]
        held[0] = np.zeros(1, np.int64)
        first = np.cumsum([0, *map(len, held)])
        self.bits = np.zeros((first[-1], base, len(self.langs)), np.float32)
        # the suffix of a context, one byte shorter and in the table
        def shorter(order, ctx):
            for k in range(order - 1, -1, -1):
                s = ctx % base**k
                at = np.minimum(np.searchsorted(held[k], s), len(held[k]) - 1)
                yield k, at, held[k][at] == s

        self.state = np.zeros((base, base, base), np.int32)
        for order in range(ORDER + 1):
            ctx = held[order]
            if order:
                up, open_ = np.zeros(len(ctx), np.int64), np.ones(len(ctx), bool)
                for k, at, ok in shorter(order, ctx):
                    take = open_ & ok
                    up[take] = first[k] + at[take]
                    open_ &= ~ok
            for j, (lang, tree) in enumerate(zip(tables, trees, strict=True)):
                below = self.bits[up, :, j] if order else np.full((1, base), 8.0)
                mine, total, kinds = tree[order]
                rows = np.searchsorted(ctx, mine)
                out = below.copy()
                out[rows] += np.log2((total + kinds) / kinds)[:, None]
                keys, n = lang[order]
                c = keys // base
                at = np.minimum(np.searchsorted(mine, c), max(len(mine) - 1, 0))
                ok = mine[at] == c if len(mine) else np.zeros(len(c), bool)
                keys, n, at = keys[ok], n[ok], at[ok]
                out[rows[at], keys % base] = -np.log2(n / (total[at] + kinds[at]))
                self.bits[first[order] : first[order + 1], :, j] = out
            if order:
                parts = [ctx // base ** (order - 1 - i) % base for i in range(order)]
                for k, state in zip(zip(*parts, strict=True), range(first[order], first[order + 1]), strict=True):
                    self.state[(slice(None),) * (3 - order) + k] = state

    def lengths(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Bits of each text of a piece in each language."""
        n = len(data)
        c = np.zeros(n + 3, np.int64)
        c[3:] = self.classes[tx.LOWER[data]]
        out = np.zeros((len(off) - 1, len(self.langs)))
        if not n:
            return out
        back = [c[2 : n + 2].copy(), c[1 : n + 1].copy(), c[0:n].copy()]
        for k in range(3):  # nothing reaches back over a text's start
            for i in range(k + 1):
                at = off[:-1] + i
                back[k][at[at < off[1:]]] = 0
        state = self.state.ravel()[(back[2] * self.base + back[1]) * self.base + back[0]]
        bits = self.bits.reshape(-1, len(self.langs))[state.astype(np.int64) * self.base + c[3:]]
        some = np.flatnonzero(off[1:] > off[:-1])
        out[some] = np.add.reduceat(bits.astype(np.float64), off[:-1][some], axis=0)
        return out


def predictor(held):
    def run(batches):
        model: Model = held.value
        for batch in batches:
            bits = np.zeros((len(batch), max(1, len(model.langs))))
            for row, rows, data, off in tx.pieces(batch.column("text")):
                if model.langs:
                    bits[row : row + rows] = model.lengths(data, off)
            best = bits.argmin(1)
            score = 1 / np.exp2(np.clip(bits.min(1, keepdims=True) - bits, -1000, 0)).sum(1) if len(bits) else bits[:, 0]
            some = np.asarray(batch.column("letters")) & bool(model.langs)
            names = np.array([*model.langs, "und"], object)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names[np.where(some, best, len(model.langs))], pa.string()), pa.array(np.where(some, np.round(score, 6), 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, train_bytes: int = TRAIN_BYTES) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    model = Model(training(docs, train_bytes))
    kind = dict(docs.dtypes)["doc_id"]
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", held_out().alias("held_out"), "text", letters.alias("letters"))
    return rows.mapInArrow(predictor(docs.sparkSession.sparkContext.broadcast(model)), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
