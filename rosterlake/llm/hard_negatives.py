"""Hard negatives by a vector-approximation file.

A component x counts as floor(256 * x), a score is the inner product of two
rows. Each dimension is quantised into cells by quantiles of a bounded sample;
every row is written, in blocks, with the cells it falls in beside its exact
components. A query looks its products with the bounds of each cell up in a
table, so the sum over a row's cells bounds the row's score from above and from
below; only rows whose bounds let them enter one of the query's windows are
scored exactly, and each found score narrows the window.

Anchors come in slices of some ``slice_bytes`` of components, which the driver
sends to every task; a slice is searched twice. Its positives are the best rows
of its own label, and each positive's share of score spans a window in which the
best rows of other labels are sought. A share of the blocks is searched first,
so that what is known of a window's last place keeps most rows from being
returned at all by the rest: a task returns a window's places, not its rows.
Work is anchors times rows in table lookups, which is what an exact answer takes;
labels or vectors that very many rows share make no larger task.

Edge cases: rows with a null id, label, vector or component, or a component that
isn't finite, take no part, nor do rows whose scaled components sum up to 2**28
or more (absolute values, one added to each), as their scores can't be compared in 64 bits; missing
components of a shorter vector count as 0; rows that share an id, or are
repeated, are rows of their own, equal scores and ids in any order; a positive
score of 0 asks for negatives of 0, one below 0 has none; no anchors, or an
empty table, give no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import settled, small_batches

SCALE = 256
CELLS = 64
#: Rows that the cells' bounds are taken from.
SAMPLE_ROWS = 4096
BLOCK_ROWS = 4096
SLICE_BYTES = 8 << 20
#: One block in so many is searched first.
SCOUTS = 16
#: Rows and anchors whose bounds are held at once, and pairs that are scored at once.
ROWS, ANCHORS, PAIRS = 1024, 256, 1 << 16
FAR = 1 << 28
ANY = 1 << 60


def usable(vectors: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    held = vectors.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{label}`").cast("bigint").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    scaled = F.transform("vector", lambda x: F.abs(x * SCALE))
    small = F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x + 1) < FAR  # false for NaN and infinity, too
    return held.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)) & small)


def matrix(vectors: pa.Array) -> np.ndarray:
    """Scaled components as whole numbers, one row for each vector, shorter ones filled up with 0."""
    flat = np.floor(np.asarray(vectors.flatten(), dtype=np.float64) * SCALE).astype(np.int64)
    size = np.asarray(vectors.value_lengths(), dtype=np.int64)
    if len(size) and (size == size[0]).all():
        return flat.reshape(len(size), size[0])
    out = np.zeros((len(size), size.max(initial=0)), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def marks(rows: DataFrame, cells: int, sample_rows: int) -> np.ndarray:
    """Where the cells of each dimension begin, all but the first; from the rows with the least hashes."""
    held = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("vector").toArrow().column("vector").combine_chunks()
    found = matrix(held) if len(held) else np.zeros((1, 0), np.int64)
    return np.ascontiguousarray(np.quantile(found, np.arange(1, cells) / cells, axis=0, method="higher").T).astype(np.int64)


def padded(a: np.ndarray, width: int, fill: int = 0) -> np.ndarray:
    """A matrix with so many columns."""
    return a if a.shape[1] >= width else np.pad(a, ((0, 0), (0, width - a.shape[1])), constant_values=fill)


def index(rows: DataFrame, cells: int = CELLS, sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, np.ndarray]:
    """The approximation file, written in blocks, and the cells' marks."""
    begins = marks(rows, cells, sample_rows)

    def blocks(batches):
        lane, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                values = matrix(part.column("vector"))
                n, width = values.shape
                cell = np.zeros((n, width), np.uint8)
                for d in range(min(width, len(begins))):
                    cell[:, d] = np.searchsorted(begins[d], values[:, d], "right")
                size = next(t for t in (np.int16, np.int32, np.int64) if not n or not width or (values >= np.iinfo(t).min).all() and (values <= np.iinfo(t).max).all())
                row = [lane << 20 | made, n, width, part.column("id").to_numpy(zero_copy_only=False).tobytes(), part.column("label").to_numpy(zero_copy_only=False).tobytes(), cell.tobytes(), np.dtype(size).itemsize, values.astype(size).tobytes()]
                made += 1
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names)

    names = ["block", "n", "width", "ids", "labels", "cells", "bytes", "parts"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
    fields = "block bigint, n int, width int, ids binary, labels binary, cells binary, bytes int, parts binary"
    with small_batches(rows.sparkSession):
        return settled(rows.mapInArrow(blocks, fields)), begins


class Block:
    """Rows of the approximation file."""

    def __init__(self, row: dict):
        n, width = row["n"], row["width"]
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.cells = np.frombuffer(row["cells"], np.uint8).reshape(n, width)
        self.values = np.frombuffer(row["parts"], f"<i{row['bytes']}").reshape(n, width)
        self.uids = (row["block"] << 12) + np.arange(n)
        self.least, self.most = self.values.min(axis=0, initial=0).astype(np.int64), self.values.max(axis=0, initial=0).astype(np.int64)

    def bounds(self, begins: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest component of each cell, by dimension; no wider than the block's own."""
        low = np.repeat(self.least[:width, None], begins.shape[1] + 1, axis=1)
        high = np.repeat(self.most[:width, None], begins.shape[1] + 1, axis=1)
        k = min(width, len(begins))
        low[:k, 1:] = np.maximum(low[:k, 1:], begins[:k])
        high[:k, :-1] = np.minimum(high[:k, :-1], begins[:k] - 1)
        return low, high


def unpacked(batches):
    for batch in batches:
        for row in batch.to_pylist():
            yield Block(row)


class Search:
    """The best `want` rows of each window of each anchor, over the blocks of a task.

    lows, highs: the windows' bounds (anchors x windows). last: the score that a row of a window must reach, as far as that is known.
    """

    def __init__(self, q: np.ndarray, uids: np.ndarray, labels: np.ndarray, lows: np.ndarray, highs: np.ndarray, last: np.ndarray, want: int, same: bool, begins: np.ndarray):
        self.q, self.uids, self.labels, self.want, self.same, self.begins = q, uids, labels, want, same, begins
        self.highs, self.floor, self.alive = highs, np.maximum(lows, last), lows <= highs
        self.floor[~self.alive] = ANY
        self.found = [np.zeros(0, np.int64)] * 4  # anchor, window, score, id

    def add(self, block: Block) -> None:
        width = min(self.q.shape[1], block.cells.shape[1])
        low, high = block.bounds(self.begins, width)
        far = int(max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)))
        kind = np.int32 if far * int(np.abs(self.q).sum(axis=1).max(initial=0)) < 1 << 31 else np.int64
        low, high, cells = low.astype(kind), high.astype(kind), np.ascontiguousarray(block.cells[:, :width].T)
        living = self.alive.any(axis=1)
        if self.same:
            groups = [(np.flatnonzero(block.labels == x), np.flatnonzero(living & (self.labels == x))) for x in np.intersect1d(block.labels, self.labels).tolist()]
        else:
            groups = [(np.arange(len(block.ids)), np.flatnonzero(living))]
        for rows, anchors in groups:
            for a in range(0, len(anchors), ANCHORS):
                mine = anchors[a : a + ANCHORS]
                q = self.q[mine, :width].T.astype(kind)
                one, two = low[:, :, None] * q[:, None, :], high[:, :, None] * q[:, None, :]
                upper, lower = np.maximum(one, two), np.minimum(one, two)
                for r in range(0, len(rows), ROWS):
                    self.narrow(block, cells, rows[r : r + ROWS], mine, upper, lower)

    def narrow(self, block: Block, cells: np.ndarray, rows: np.ndarray, mine: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        """Bounds of all pairs of rows and anchors; those that may enter a window are scored."""
        most = np.zeros((len(rows), len(mine)), upper.dtype)
        for d in range(len(upper)):
            most += upper[d].take(cells[d, rows], axis=0)
        floor = self.floor[mine]
        r, a = np.nonzero(most >= np.minimum(floor.min(axis=1), np.iinfo(most.dtype).max)[None, :])
        same = block.labels[rows[r]] == self.labels[mine[a]]
        keep = same & (block.uids[rows[r]] != self.uids[mine[a]]) if self.same else ~same
        r, a = r[keep], a[keep]
        kept = []
        for k in range(0, len(r), PAIRS):
            rk, ak = r[k : k + PAIRS], a[k : k + PAIRS]
            least = np.zeros(len(rk), np.int64)
            for d in range(len(lower)):
                least += lower[d, cells[d, rows[rk]], ak]
            may = ((most[rk, ak][:, None] >= floor[ak]) & (least[:, None] <= self.highs[mine[ak]])).any(axis=1)
            rk, ak = rows[rk[may]], mine[ak[may]]
            score = np.einsum("ij,ij->i", block.values[rk, : len(upper)].astype(np.int64), self.q[ak, : len(upper)])
            at, window = np.nonzero((score[:, None] >= self.floor[ak]) & (score[:, None] <= self.highs[ak]))
            kept.append((ak[at], window, score[at], block.ids[rk[at]]))
        if kept and sum(len(x[0]) for x in kept):
            self.settle([np.concatenate(x) for x in zip(*kept, strict=True)])

    def settle(self, more: list[np.ndarray]) -> None:
        """Takes rows in; of each window only the best stay."""
        touched = np.isin(self.found[0], more[0])
        some = [np.concatenate((x[touched], y)) for x, y in zip(self.found, more, strict=True)]
        order = np.lexsort((some[3], -some[2], some[1], some[0]))
        some = [x[order] for x in some]
        new = np.r_[True, (some[0][1:] != some[0][:-1]) | (some[1][1:] != some[1][:-1])]
        first = np.flatnonzero(new)
        place = np.arange(len(new)) - np.repeat(first, np.diff(np.r_[first, len(new)]))
        full = place == self.want - 1
        self.floor[some[0][full], some[1][full]] = np.maximum(self.floor[some[0][full], some[1][full]], some[2][full])
        self.found = [np.concatenate((x[~touched], y[place < self.want])) for x, y in zip(self.found, some, strict=True)]


_FOUND = "anchor int, window int, score bigint, id bigint"


def best(blocks: DataFrame, queries: dict, want: int, same: bool) -> DataFrame:
    """The best rows of each window, as anchor and window (their places in queries), score, id and place (from 1)."""
    held = blocks.sparkSession.sparkContext.broadcast(queries)

    def look(batches):
        search = Search(**held.value, want=want, same=same)
        for block in unpacked(batches):
            search.add(block)
        anchor, window, score, ids = search.found
        yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int32()), pa.array(window, pa.int32()), pa.array(score), pa.array(ids)], ["anchor", "window", "score", "id"])

    ranks = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id"))
    return blocks.mapInArrow(look, _FOUND).withColumn("place", ranks).where(F.col("place") <= want)


def searched(blocks: DataFrame, queries: dict, want: int, same: bool) -> DataFrame:
    """best(), with each window's last place from a share of the blocks known beforehand."""
    shape = queries["last"].shape
    scouts = best(blocks.where(F.pmod(F.xxhash64("block"), F.lit(SCOUTS)) == 0), queries, want, same)
    known = scouts.where(F.col("place") == want).select("anchor", "window", "score").toPandas()  # a row for each window of a slice
    last = np.full(shape, -ANY)
    last[known["anchor"], known["window"]] = known["score"]
    return best(blocks, queries | {"last": last}, want, same)


def mine(
    vectors: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding", every: int = 50, positives: int = 5, negatives: int = 3,
    least: int = 50, most: int = 95, cells: int = CELLS, sample_rows: int = SAMPLE_ROWS, slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """For each anchor (id divisible by every) and each of its positives, the best rows of other labels with a score of least to most percent of the positive's.

    Columns: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.
    """
    blocks, begins = index(usable(vectors, key, label, vector), cells, sample_rows)

    def pick(batches):
        for block in unpacked(batches):
            at = np.flatnonzero(block.ids % every == 0)
            yield pa.RecordBatch.from_arrays([pa.array(block.uids[at]), pa.array(block.ids[at]), pa.array(block.labels[at]), pa.array([x.tobytes() for x in block.values[at].astype(np.int64)], pa.binary())], ["uid", "id", "label", "parts"])

    anchors = settled(blocks.mapInArrow(pick, "uid bigint, id bigint, label bigint, parts binary"))
    size = anchors.agg(F.coalesce(F.sum(F.octet_length("parts") + 8), F.lit(0)).alias("n")).first()["n"]
    slices = -(-size // slice_bytes)
    found = []
    for k in range(slices):
        held = anchors.where(F.pmod(F.xxhash64("uid"), F.lit(slices)) == k).orderBy("label", "uid").toArrow()
        parts = [np.frombuffer(x, np.int64) for x in held.column("parts").to_pylist()]
        q = np.zeros((len(parts), max(map(len, parts), default=0)), np.int64)
        for row, x in zip(q, parts, strict=True):
            row[: len(x)] = x
        ids = held.column("id").to_numpy()
        common = {"q": q, "uids": held.column("uid").to_numpy(), "labels": held.column("label").to_numpy(), "begins": begins}
        whole = np.full((len(ids), 1), ANY)
        near = searched(blocks, common | {"lows": -whole, "highs": whole - 1, "last": -whole}, positives, same=True).toPandas()  # positives rows for each anchor of a slice
        near_id, near_score = np.zeros((len(ids), positives), np.int64), np.zeros((len(ids), positives), np.int64)
        there = np.zeros((len(ids), positives), bool)
        at = near["anchor"].to_numpy(), near["place"].to_numpy() - 1
        near_id[at], near_score[at], there[at] = near["id"], near["score"], True
        lows, highs = -(-least * near_score // 100), most * near_score // 100
        lows[~there], highs[~there] = 1, 0
        far = searched(blocks, common | {"lows": lows, "highs": highs, "last": np.full(lows.shape, -ANY)}, negatives, same=False)
        names = blocks.sparkSession.createDataFrame(pa.table({"a": np.repeat(np.arange(len(ids)), positives).astype(np.int32), "w": np.tile(np.arange(positives), len(ids)).astype(np.int32), "anchor_id": np.repeat(ids, positives), "positive_id": near_id.ravel(), "positive_score": near_score.ravel()}))
        joined = far.join(names, (F.col("anchor") == F.col("a")) & (F.col("window") == F.col("w")))
        found.append(settled(joined.select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))))
    if not found:
        return blocks.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    return reduce(DataFrame.unionAll, found)


#: The query's rows, by all scores of all anchors.
ORACLE = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, a.label AS al, e.r, e.vec_id, e.label, CAST(list_inner_product(a.v, e.v) AS BIGINT) AS score FROM e AS a, e WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) AS k FROM s WHERE label = al AND r <> ar) WHERE k <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.ar, p.r ORDER BY s.score DESC, s.vec_id) AS rank
 FROM p JOIN s ON s.ar = p.ar AND s.label <> p.al AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
