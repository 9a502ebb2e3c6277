"""Quality by Bradley-Terry ranking.

Every labelled document of quality 1 is preferred to every one of quality 0. The
logistic loss on the difference of their features, over all of these pairs, is
minimised by Newton steps. A document's raw score is its place on that scale.
The threshold is the quantile of the labelled documents' raw scores at the share
of the worse ones, and scores are shifted so that this quantile maps to ``AT``
(0.7).

Features are counted on whole texts: shares of bytes, and what words and lines
look like. Labelled rows are neither sampled nor paired up: in a pass over their
features, a row's place on the scale falls between two points of a grid (``STEP``
apart, to ``REACH`` either side of the mean), and counts and feature sums by
point and label are all that the loss over pairs takes; a second pass adds up
weighted squares for the Newton step. So a pair's probability is linear between
points (off by 0.0004 at most), and scores beyond the grid count as its ends.
Tasks add up arrays of a fixed size; the driver gets their sums.

Edge cases: null and empty texts have all features 0 and are scored like any
other; labels other than 0 and 1, and labels of rows that aren't there, are
ignored; without both labels every score is 0.5; repeated rows count each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sieve
from . import textops as tx
from ._common import discard, settled

AT = 0.7
RIDGE = 1e-3
EXTRA = 9
WIDTH = 256 + EXTRA
STEP, REACH = 1 / 8, 20
GRID = np.arange(-REACH, REACH + STEP, STEP)
#: A loss that rises by more than this is a step too far.
SLACK = 1e-6


class Features:
    def __init__(self):
        self.rolling, self.values = tx.Rolling(tx.BASE_A), tx.byte_values(7)

    def of(self, text: pa.Array) -> np.ndarray:
        """A row of features for each text."""
        out = np.zeros((len(text), WIDTH), np.float32)
        for row, rows, data, off in tx.pieces(text):
            s, e, woff = tx.words(data, off, tx.BLANK_WORDS)
            prefix = self.rolling.prefix(self.values[data])
            h = self.rolling.span(prefix, s, e)
            size = (e - s).astype(np.float64)
            breaks = np.flatnonzero(data == 10)
            for d in range(rows):
                lo, hi = off[d], off[d + 1]
                if hi == lo:
                    continue
                f = out[row + d]
                count = np.bincount(data[lo:hi], minlength=256)
                f[:256] = np.sqrt(count / (hi - lo))
                w = slice(woff[d], woff[d + 1])
                n = int(woff[d + 1] - woff[d])
                upper, letters = count[65:91].sum(), count[65:91].sum() + count[97:123].sum()
                inner = breaks[np.searchsorted(breaks, lo) : np.searchsorted(breaks, hi)]
                lines = self.rolling.span(prefix, np.r_[lo, inner + 1], np.r_[inner, hi])
                f[256] = np.log1p(n)
                f[257] = min(n, 50) / 50
                f[258] = upper / max(letters, 1)
                f[259] = 1 - len(np.unique(lines)) / len(lines)
                if n:
                    f[260] = len(np.unique(h[w])) / n
                    f[261], f[262] = size[w].mean() / 10, size[w].std() / 10
                    f[263] = np.log1p(size[w].max())
                if n > 1:
                    two = np.sort(tx.mix(h[w][:-1]) ^ h[w][1:])
                    f[264] = (two[1:] == two[:-1]).sum() / (n - 1)
        return out


def features(batches):
    look = Features()
    for batch in batches:
        x = look.of(batch.column("text"))
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "x": pa.array([r.tobytes() for r in x], pa.binary())})


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """quality, x: the features of every row to learn from."""
    key = lambda c: F.xxhash64(F.col(c).cast("string")).alias("key")
    good = labels.select(F.col("doc_id").alias("labelled_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and labelled_id is not null").where(~held_out("labelled_id"))
    keys = settled(good.select(key("labelled_id")).distinct())
    known = sieve.sifted(docs.where("doc_id is not null").select("doc_id", key("doc_id"), "text"), "key", sieve.table_of(keys))
    seen = known.select("doc_id", "text").mapInArrow(features, f"doc_id {dict(docs.dtypes)['doc_id']}, x binary")
    rows = settled(good.join(seen, F.col("doc_id") == F.col("labelled_id")).select("quality", "x"))
    discard(keys)
    return rows


def added(rows: DataFrame, one) -> np.ndarray:
    """The sum of the arrays that one(quality, x) makes of each batch of examples, added up in the tasks and then between them."""

    def run(batches):
        total = 0
        for batch in batches:
            if len(batch):
                x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(-1, WIDTH)
                total = total + one(np.asarray(batch.column("quality")), x.astype(np.float64))
        if not np.isscalar(total):
            yield pa.RecordBatch.from_pydict({"held": pa.array([tx.blob(total)], pa.binary())})

    return rows.mapInArrow(run, "held binary").rdd.map(lambda r: np.frombuffer(r.held)).treeReduce(np.add)


def moments(y, x):
    """Rows of either label, sums of features and of their squares."""
    return np.r_[(y == 0).sum(), (y == 1).sum(), x.sum(0), (x * x).sum(0)]


def between(s: np.ndarray):
    """(grid point below, share of the point above) of each raw score."""
    at = (np.clip(s, GRID[0], GRID[-1]) - GRID[0]) / STEP
    k = np.minimum(at.astype(np.int64), len(GRID) - 2)
    return k, at - k


def places(w: np.ndarray, mean: np.ndarray, scale: np.ndarray):
    """For labels 0 and 1 and each grid point: rows and feature sums."""

    def one(y, x):
        z = (x - mean) / scale
        k, up = between(z @ w)
        z = np.c_[np.ones(len(z)), z]
        out = np.zeros((2 * len(GRID), WIDTH + 1))
        for at, share in ((k, 1 - up), (k + 1, up)):
            at = y * len(GRID) + at
            order = np.argsort(at, kind="stable")
            bounds = tx.run_bounds(at[order])[:-1]
            out[at[order][bounds]] += np.add.reduceat((z * share[:, None])[order], bounds)
        return out.ravel()

    return one


def squares(w: np.ndarray, mean: np.ndarray, scale: np.ndarray, weight: np.ndarray):
    """Products of features, weighted by label and place."""

    def one(y, x):
        z = (x - mean) / scale
        k, up = between(z @ w)
        of = weight[y, k] * (1 - up) + weight[y, k + 1] * up
        return ((z * of[:, None]).T @ z).ravel()

    return one


def ranked(raw: DataFrame, k: int) -> float:
    """The k-th least value of the column raw, by counts in ever smaller ranges."""
    lo, hi = raw.agg(F.min("raw"), F.max("raw")).first()
    below = 0
    while lo < hi:
        cell = F.least(F.floor((F.col("raw") - lo) / (hi - lo) * 1024), F.lit(1023)).alias("cell")
        for _, n, lo, hi in raw.where(F.col("raw").between(lo, hi)).groupBy(cell).agg(F.count("*"), F.min("raw"), F.max("raw")).orderBy("cell").collect():
            if below + n >= k:
                break
            below += n
    return lo


def threshold(rows: DataFrame, weights: np.ndarray, k: int) -> float:
    """Between the k-th and the next raw score of all examples."""

    def run(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_pydict({"raw": pa.array(x @ weights, pa.float64())})

    raw = settled(rows.mapInArrow(run, "raw double"))
    one = ranked(raw, k)
    upto, more = raw.agg(F.count_if(F.col("raw") <= one), F.min(F.when(F.col("raw") > one, F.col("raw")))).first()
    discard(raw)
    return (one + (one if upto > k else more)) / 2


def fit(rows: DataFrame, steps: int = 25):
    """(weights, shift): raw score x @ weights + shift, with AT at the threshold; None if a label is missing. rows: what labelled() gives."""
    if rows.agg(F.count_distinct("quality")).first()[0] < 2:
        return None
    total = added(rows, moments)
    bad, good = total[:2]
    mean, square = total[2:].reshape(2, -1) / (bad + good)
    scale = np.sqrt(np.maximum(square - mean * mean, 0)) + 1e-3
    apart = GRID[:, None] - GRID[None, :]  # the better one's place less the worse one's
    lost = 1 / (1 + np.exp(apart))
    w, step, last = np.zeros(WIDTH), np.zeros(WIDTH), np.inf
    for _ in range(steps):
        found = added(rows, places(w, mean, scale)).reshape(2, len(GRID), WIDTH + 1)
        (n0, n1), (x0, x1) = found[:, :, 0], found[:, :, 1:]
        loss = n1 @ np.logaddexp(0, -apart) @ n0 / (bad * good) + RIDGE * (w @ w) / 2
        if loss > last + SLACK:
            step = step / 2
            w = w + step
            continue
        last = loss
        grad = ((lost.T @ n1) @ x0 - (lost @ n0) @ x1) / (bad * good) + RIDGE * w
        unsure = lost * (1 - lost) / (bad * good)
        crossed = x1.T @ unsure @ x0
        hess = added(rows, squares(w, mean, scale, np.stack([unsure.T @ n1, unsure @ n0]))).reshape(WIDTH, WIDTH) - crossed - crossed.T + RIDGE * np.eye(WIDTH)
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    weights = w / scale
    return weights, float(np.log(AT / (1 - AT)) - threshold(rows, weights, int(bad)))


def scorer(model, kind: str):
    def run(batches):
        look = Features()
        for batch in batches:
            x = look.of(batch.column("text"))
            score = np.full(len(x), 0.5) if model is None else 1 / (1 + np.exp(-np.clip(x @ model[0] + model[1], -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(np.round(score, 6))], ["doc_id", "held_out", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    rows = labelled(docs, labels)
    model = fit(rows)
    discard(rows)
    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(scorer(model, kind), f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= AT).cast("int"))
