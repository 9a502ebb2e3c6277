"""Benchmark decontamination: a broadcast hash set of normalised n-grams.

Texts are lower-cased (A-Z) and cut into words of ASCII letters, digits and
anything beyond ASCII. A window is ``n`` consecutive words of a benchmark item;
a shorter item that has words is one window. The windows' hashes are broadcast,
training texts are scanned window by window, and each hit is verified on the
words themselves before it counts. No row is shuffled.

A broadcast holds at most ``slice_bytes`` of benchmark text, as flat arrays of
some 7 times that size: a larger benchmark is dealt to several slices, and the
documents pass one scan after the other in the same stage, each adding its hits.

Edge cases: a null or empty text, or one without words, has no words and no
hits; a null item text has no windows; an item without an id contaminates but
is not listed; repeated rows are judged one by one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx

WINDOW = 10
SLICE_BYTES = 16 << 20
TABLE_BITS = 22


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rolling: tx.Rolling, values: np.ndarray) -> np.ndarray:
    return rolling.span(rolling.prefix(values[data]), starts, ends)


class Windows:
    """The different windows of some items, as flat arrays: sorted hashes, where their words stand, and the items of each.

    Held are the texts and about 40 bytes for each window, and a window starts at each word: some 7 times the text.
    """

    def __init__(self, items: pa.Table, n: int):
        by_bytes, by_words, values = tx.Rolling(tx.BASE_A), tx.Rolling(tx.BASE_B), tx.byte_values()
        self.items = items.column("item").to_pylist()
        known = np.array([x is not None for x in self.items], bool)
        text = pa.concat_arrays(items.column("passage").chunks) if items.num_rows else pa.array([], pa.string())
        self.data, found, base = [], {}, 0
        for row, rows, data, off in tx.pieces(text):
            data = tx.LOWER[data]
            s, e, woff = tx.words(data, off, tx.ALNUM_WORDS)
            count = np.diff(woff)
            prefix = by_words.prefix(word_hashes(data, s, e, by_bytes, values))
            again = by_bytes.prefix(word_hashes(data, s, e, by_words, values))
            for size in np.unique(np.minimum(count[count > 0], n)).tolist():
                mine = np.flatnonzero(count >= n if size == n else count == size)
                many = count[mine] - size + 1
                at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(woff[mine], many)
                h = by_words.span(prefix, at, at + size)
                h2 = by_bytes.span(again, at, at + size)  # windows of one hash are told apart by another
                found.setdefault(size, []).append((h, h2, s[at] + base, e[at + size - 1] + base, np.repeat(mine + row, many)))
            self.data.append(data)
            base += len(data)
        self.data = np.concatenate(self.data) if self.data else np.zeros(0, np.uint8)
        self.by_size = {}
        for size, parts in found.items():
            h, h2, lo, hi, item = map(np.concatenate, zip(*parts, strict=True))
            order = np.lexsort((item, h2, h))
            h, h2, lo, hi, item = h[order], h2[order], lo[order], hi[order], item[order]
            first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])])
            keep = known[item]
            upto = np.r_[0, np.cumsum(keep)]
            self.by_size[size] = h[first], lo[first].astype(np.int64), hi[first].astype(np.int64), upto[np.r_[first, len(h)]].astype(np.int64), item[keep].astype(np.int32)

    def words_at(self, lo: int, hi: int) -> bytes:
        """The words between two places, with one space between them."""
        data = self.data[lo:hi]
        s, e, _ = tx.words(data, np.array([0, len(data)]), tx.ALNUM_WORDS)
        held = data.tobytes()
        return b" ".join(held[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True))


def scanner(held, n: int):
    """The scan of one slice: adds hit word spans and items to what earlier scans found."""

    def scan(batches):
        windows: Windows = held.value
        by_bytes, by_words, values = tx.Rolling(tx.BASE_A), tx.Rolling(tx.BASE_B), tx.byte_values()
        seen = {}
        for size, (keys, *_) in windows.by_size.items():
            seen[size] = np.zeros(1 << TABLE_BITS, bool)
            seen[size][keys >> tx.U64(64 - TABLE_BITS)] = True
        for batch in batches:
            text = batch.column("text")
            counts, hits, items = [], batch.column("hits").to_pylist(), batch.column("items").to_pylist()
            for row, rows, data, off in tx.pieces(text):
                data = tx.LOWER[data]
                s, e, woff = tx.words(data, off, tx.ALNUM_WORDS)
                counts.append(np.diff(woff))
                if not len(s):
                    continue
                prefix = by_words.prefix(word_hashes(data, s, e, by_bytes, values))
                end_of = np.repeat(woff[1:], np.diff(woff))
                for size, (keys, lo, hi, upto, of) in windows.by_size.items():
                    at = np.arange(len(s) - size + 1)
                    at = at[at + size <= end_of[: len(at)]] if len(at) else at
                    if not len(at):
                        continue
                    h = by_words.span(prefix, at, at + size)
                    maybe = np.flatnonzero(seen[size][h >> tx.U64(64 - TABLE_BITS)])
                    k = np.searchsorted(keys, h[maybe])
                    maybe, k = maybe[m := keys[np.minimum(k, len(keys) - 1)] == h[maybe]], k[m]
                    for w, k, name in zip(at[maybe].tolist(), k.tolist(), h[maybe].tolist(), strict=True):
                        gram = b" ".join(data[s[j] : e[j]].tobytes() for j in range(w, w + size))
                        while k < len(keys) and keys[k] == name:
                            if windows.words_at(lo[k], hi[k]) == gram:
                                d = int(np.searchsorted(woff, w, "right")) - 1
                                hits[row + d].append({"begin": w - int(woff[d]), "end": w - int(woff[d]) + size})
                                items[row + d].extend(windows.items[i] for i in of[upto[k] : upto[k + 1]].tolist())
                                break
                            k += 1
            out = {k: batch.column(k) for k in batch.schema.names}
            if counts:
                out["n_words"] = pa.array(np.concatenate(counts), pa.int64())
            out["hits"] = pa.array(hits, batch.schema.field("hits").type)
            out["items"] = pa.array([sorted(set(x)) for x in items], batch.schema.field("items").type)
            yield pa.RecordBatch.from_pydict(out, schema=batch.schema)

    return scan


def scan(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The given columns (text among them) with n_words, hits (word spans) and items, before any decision."""
    spark = docs.sparkSession
    sized = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("passage")).where("passage is not null")
    total = sized.agg(F.coalesce(F.sum(F.octet_length("passage")), F.lit(0)).alias("n")).first()["n"]
    slices = max(1, -(-total // slice_bytes))
    out = docs.select(
        *docs.columns, F.lit(0).cast("bigint").alias("n_words"),
        F.expr("cast(array() as array<struct<begin:int,end:int>>)").alias("hits"), F.expr("cast(array() as array<string>)").alias("items"),
    )
    for k in range(slices):
        mine = sized if slices == 1 else sized.where(F.pmod(F.xxhash64("item", "passage"), F.lit(slices)) == k)
        windows = Windows(mine.toArrow(), n)
        out = out.mapInArrow(scanner(spark.sparkContext.broadcast(windows), n), out.schema)
    return out


def report(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = scan(docs.select("doc_id", "text"), benchmark, n)
    hit = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["begin"], h["end"] - 1)))))
    return found.select(
        "doc_id", "n_words", F.when(F.size("hits") > 0, hit).otherwise(0).cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def without_spans(batches):
    """Cuts the hit words, from the first byte of a hit to the last, out of the texts."""
    for batch in batches:
        texts = []
        for text, hits in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist(), strict=True):
            if hits:
                raw = np.frombuffer(text.encode(), np.uint8)
                s, e, _ = tx.words(tx.LOWER[raw], np.array([0, len(raw)]), tx.ALNUM_WORDS)
                keep = np.ones(len(raw), bool)
                for h in hits:
                    keep[s[h["begin"]] : e[h["end"] - 1]] = False
                text = raw[keep].tobytes().decode()
            texts.append(text)
        yield pa.RecordBatch.from_pydict({k: pa.array(texts, pa.string()) if k == "text" else batch.column(k) for k in batch.schema.names}, schema=batch.schema)


def clean(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, mode: str = "document") -> DataFrame:
    """The documents' own columns: without contaminated rows ("document") or without hit spans ("span")."""
    if mode not in ("document", "span"):
        raise ValueError(f"mode is {mode!r}, not 'document' or 'span'")
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]).alias("rest") if len(docs.columns) > 2 else F.struct(F.lit(0).alias("none")).alias("rest"))
    found = scan(packed, benchmark, n)
    found = found.where(F.size("hits") == 0) if mode == "document" else found.mapInArrow(without_spans, found.schema)
    return found.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
grams AS (SELECT DISTINCT item, k, unnest(list_transform(range(1, CAST(len(w) - k + 2 AS BIGINT)), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS g FROM sized),
sizes AS (SELECT DISTINCT k FROM grams),
dw AS (SELECT rid, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i, unnest(list_transform(range(1, CAST(len(w) - k + 2 AS BIGINT)), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS g FROM d, sizes WHERE len(w) >= k),
hit AS (SELECT rid, i, grams.k, item FROM dw JOIN grams ON dw.k = grams.k AND dw.g = grams.g),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid),
pos AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + k)) AS p FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN items USING (rid) LEFT JOIN pos USING (rid)
"""
