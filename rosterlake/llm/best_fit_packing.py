"""Best-fit packing of token sequences: exact complements first, best fit for the rest.

Texts become token ids, an end id follows each, and only documents longer than
``capacity`` are cut, into pieces of that length (the first may be shorter).
What a packing needs to know is how many pieces there are of each length, so
the plan is made on that histogram, which is bounded by ``capacity`` whatever
the corpus holds. Sums of one, two and three lengths that are still there are
indexed. A sequence opens with the longest length left; a combination that
fills its gap exactly is consumed, for as many sequences at once as the counts
allow; without one, the longest length that fits goes in and the rest of the
gap is looked up again. Each pattern uses up a length, so there are few.

Each piece has a number among those of its length (its task's offset and its
place in the task), and patterns take ranges of these numbers: every piece finds
its sequence and place by one search. A length that a third of all pieces have
is spread over all tasks like any other.

Ids are those of the tokenizer file. They are made from the same vocabulary in
its form as ranks, by a library that is four times as fast: both give the same
ids for every code point between letters, digits, marks and spaces (compared
one by one) and for the texts of the tests. Texts with a special token, or with
white space of 50000 characters and more, go through the tokenizer file itself.

Edge cases: a null or empty text is the end id alone; a special token in a
text is one id, as the tokenizer has it; a null doc_id is a document like any other and repeated
rows are packed one by one (their rows differ in sequence_id or offset only);
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import settled, small_batches

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
#: The same vocabulary for the faster library; None: only the tokenizer file is used.
RANKS = "byte_bpe_50k.tiktoken"
LONG_RUN = 50_000
ALL_SPACE = re.compile(rf"\s{{{LONG_RUN}}}")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers: those of the tokenizer file, by its ranks where these give the same."""

    def __init__(self, path: str, ranks: str | None):
        self.path, self.fast = located(path), None
        with open(self.path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(located(ranks), "rb") as f:
                known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})

    @cached_property
    def tokenizer(self):
        """Few texts need it, where there are ranks."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def plain(self, text: str) -> bool:
        """No special token, which the ranks lack, and no run of white space that its pattern would recurse on too deeply."""
        return not any(s in text for s in self.special) and (len(text) < LONG_RUN or not ALL_SPACE.search(text))

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        fast = self.fast is not None and self.plain(text)
        return np.array(self.fast.encode_ordinary(text) if fast else self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def located(path: str) -> str:
    """A name without a folder is one of the installed public tokenizers."""
    if os.path.isabs(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


@cache
def encoder(path: str, ranks: str | None) -> Encoder:
    """One for each Python worker."""
    return Encoder(path, ranks)


class Numbered:
    """Counts through the values 0 to n - 1, batch after batch."""

    def __init__(self, n: int):
        self.seen = np.zeros(n, np.int64)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        order = np.argsort(values, kind="stable")
        ordered = values[order]
        out = np.empty(len(values), np.int64)
        out[order] = np.arange(len(values)) - np.searchsorted(ordered, ordered) + self.seen[ordered]
        self.seen += np.bincount(values, minlength=len(self.seen))
        return out


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, ranks: str | None = RANKS, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, its task and its number among the task's pieces of that length; with_ids adds ids."""
    fields = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start bigint, length bigint, ids_crc32 bigint, lane int, nth bigint" + ", ids binary" * with_ids

    def cut(batches):
        encode, number = encoder(tokenizer, ranks), Numbered(capacity + 1)
        end, lane = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        for batch in batches:
            ids = [encode(x) + end for x in batch.column("text").to_pylist()]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            many = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            first = (n - (many - 1) * capacity)[row]
            start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
            length = np.where(piece == 0, first, capacity)
            held = [ids[r][4 * a : 4 * (a + k)] for r, a, k in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
            out = [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in held], pa.int64()), pa.array(np.full(len(row), lane, np.int32)), pa.array(number(length))]
            yield pa.RecordBatch.from_arrays(out + [pa.array(held, pa.binary())] * with_ids, ["doc_id", "piece", "start", "length", "ids_crc32", "lane", "nth"] + ["ids"] * with_ids)

    return docs.select("doc_id", "text").mapInArrow(cut, fields)


class Sums:
    """How many pieces there are of each length, with an index of the sums of two lengths that are there."""

    def __init__(self, counts: np.ndarray, even: bool = False):
        self.even = even
        self.left, self.top = counts.astype(np.int64), len(counts) - 1
        self.here = self.left > 0
        self.here[0] = False
        both = np.rint(np.convolve(self.here.astype(float), self.here.astype(float)))[: self.top + 1].astype(np.int64)
        both[0 : self.top + 1 : 2] += self.here[: self.top // 2 + 1]
        self.pairs = both // 2

    def take(self, length: int, n: int = 1) -> None:
        self.left[length] -= n
        if not self.left[length]:
            others = np.flatnonzero(self.here[: self.top + 1 - length])
            self.pairs[length + others] -= 1
            self.here[length] = False

    def pair(self, total: int, beside: int = 0) -> tuple[int, int] | None:
        """Two lengths of this sum, the longer as long as can be (even: as short); beside: a length of which one piece is spoken for."""
        if total < 2 or not self.pairs[total]:
            return None
        long = np.arange((total + 1) // 2, total) if self.even else np.arange(total - 1, (total - 1) // 2, -1)
        for a in long[self.here[long] & self.here[total - long]].tolist():
            b = total - a
            if self.left[a] >= 1 + (a == b) + (a == beside) and self.left[b] >= 1 + (a == b) + (b == beside):
                return a, b
        return None

    def exactly(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths that fill the gap."""
        if self.here[gap]:
            return (gap,)
        if found := self.pair(gap):
            return found
        first = np.arange(gap - 2, (gap - 1) // 3, -1)
        for a in first[self.here[first] & (self.pairs[gap - first] > 0)].tolist():
            if found := self.pair(gap - a, a):
                return (a, *found)
        return None

    def longest(self, most: int) -> int:
        """The longest length up to this one; 0: none."""
        there = np.flatnonzero(self.here[: most + 1])
        return int(there[-1]) if len(there) else 0


def patterns(counts: np.ndarray, capacity: int, complements: bool = True, even: bool = False) -> list[tuple[int, list[tuple[int, int]]]]:
    """(sequences of this kind, [(length, copies)]) until every piece has a place. even: pairs of like lengths first. Without complements, by best fit alone."""
    sums, out = Sums(counts, even), []
    while opening := sums.longest(capacity):
        sums.take(opening)
        used, gap = {opening: 1}, capacity - opening
        while gap and (found := (sums.exactly(gap) if complements else None) or ((x,) if (x := sums.longest(gap)) else None)):
            for x in found:
                sums.take(x)
                used[x] = used.get(x, 0) + 1
            gap -= sum(found)
        more = min(int(sums.left[x]) // k for x, k in used.items())
        if more:
            for x, k in used.items():
                sums.take(x, k * more)
        out.append((1 + more, sorted(used.items(), reverse=True)))
    return out


def places(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Columns: length, first number of that length, copies in a sequence, first sequence, offset; in order of the first two. Of three plans, the shortest."""
    rows, sequence, taken = [], 0, np.zeros(capacity + 1, np.int64)
    plans = [patterns(counts, capacity, even=True), patterns(counts, capacity), patterns(counts, capacity, complements=False)]
    for times, used in min(plans, key=lambda plan: sum(times for times, _ in plan)):
        offset = 0
        for length, copies in used:
            rows.append((length, int(taken[length]), copies, sequence, offset))
            taken[length] += times * copies
            offset += length * copies
        sequence += times
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 5)


def placed(cut: DataFrame, capacity: int) -> DataFrame:
    """cut, as pieces() makes it and as it was written, with sequence_id and offset."""
    spark = cut.sparkSession
    sizes = settled(cut.groupBy("lane", "length").agg(F.count(F.lit(1)).alias("n")))
    counts = np.zeros(capacity + 1, np.int64)
    for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length: capacity at most
        counts[r["length"]] = r["n"]
    held = spark.sparkContext.broadcast(places(counts, capacity))
    before = Window.partitionBy("length").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("lane", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))

    def find(batches):
        length, first, copies, sequence, offset = held.value.T
        keys = length << 48 | first
        for batch in batches:
            mine = batch.column("length").to_numpy()
            number = batch.column("earlier").to_numpy() + batch.column("nth").to_numpy()
            at = np.searchsorted(keys, mine << 48 | number, "right") - 1
            nth = number - first[at]
            out = {k: batch.column(k) for k in names} | {"sequence_id": pa.array(sequence[at] + nth // copies[at]), "offset": pa.array(offset[at] + nth % copies[at] * mine)}
            yield pa.RecordBatch.from_pydict(out)

    kept = cut.drop("lane", "nth")
    names = kept.columns
    fields = ", ".join(f"{k} {t}" for k, t in kept.dtypes) + ", sequence_id bigint, offset bigint"
    return cut.join(offsets, ["lane", "length"]).mapInArrow(find, fields)


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, ranks: str | None = RANKS, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; with_ids adds ids (little-endian unsigned 32-bit)."""
    with small_batches(docs.sparkSession):
        return placed(settled(pieces(docs, tokenizer, ranks, capacity, end_id, with_ids)), capacity)


def sequences(docs: DataFrame, tokenizer: str = TOKENIZER, ranks: str | None = RANKS, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Per sequence: sequence_id, n_tokens, ids (little-endian unsigned 32-bit) and its parts in order. A group holds capacity tokens at most."""
    part = F.struct("offset", "length", "doc_id", "piece", "ids")
    found = pack(docs, tokenizer, ranks, capacity, end_id, True).groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda held, p: F.concat(held, p["ids"]))
    return found.select("sequence_id", F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, p: n + p["length"]).alias("n_tokens"), ids.alias("ids"), F.transform("parts", lambda p: p.dropFields("ids")).alias("parts"))
