"""N-gram Jaccard join: documents whose shingle sets overlap by ``percent`` or more.

The documents by n-grams incidence matrix is multiplied with itself in blocks.
Which blocks meet is settled by size-derived bounds: sets of n and m shingles
with Jaccard t differ in at most d = (n + m)(1 - t)/(1 + t) shingles.

Keys. For sizes in a class, the hash range is cut into more parts than d, so
partners agree in all but d parts; each set files its d + 1 fullest parts (a
prefix of its parts in one fixed order), and partners meet under a key at least
once. Three things keep strangers apart:

* no empty part is a key. Partners that agree only in empty parts have so many
  empty ones each that both go on to the next way of cutting (another seed; in
  the end single shingles, the rarest first), so they meet there;
* shingles that very many sets hold (``common_shingles``: counted over all
  sets, at most 2**17 of them) are left out of the parts while enough others
  are there, so a passage in a third of all documents makes no key;
* where partners differ in one shingle each at most, the keys are the set and
  the set without each one of its shingles.

Lists. All sets of a key go on a list named by the least of them; lists of one
name are one. Two sets of a list stay together only if their sketches (counts of
shingles by hash range, whose distance is a lower bound of the number of shingles
that differ) allow a link, directly or by way of others; so documents that share
a passage part again before any set is moved. A key that more than ``HOT`` sets
of one stretch hold ties its sets together without that look.

What stays together is a group. A group's sets are dealt to blocks by size and
meet within their block; for groups of several blocks, blocks are packed once
(distinct shingles and indices, compressed) and meet where their sizes allow a
link. A task adds up the overlap counts of two blocks, some thousand n-grams at
a time. Pairs below the bound are dropped there: no pair leaves a task, only a
spanning forest of its links and each set's number of links. Where links needn't
be counted (``one_of_each``), a set of each size class is shown to every block
first, and only groups still apart after that have their blocks meet.

Copies (equal sets, told apart by 64 bits; 10**11 different sets would have
some 270 pairs taken for one) are one row throughout.

Edge cases: a document without words has an empty set, no links and itself as
component; with fewer words than ``n`` the whole sequence is its only shingle;
rows with one doc_id are one node, so what either links with is one component;
rows without doc_id link like others and get the least doc_id they reach, null
if there is none. doc_id is an integer below 2**62. Other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _repeats as rp
from . import sieve
from . import textops as tx
from ._common import buckets, discard, settled
from .components import components

N = 4
PERCENT = 85
#: Sets, and shingles, of a block.
BLOCK = 512
BLOCK_SHINGLES = 1 << 20
#: Shingles multiplied at once, bytes of text looked at once (a document is never split), and counts of sketches compared at once.
SLAB = 4096
PIECE = 1 << 18
COMPARED = 1 << 20
#: Sizes of a class differ by this factor at most.
CLASS_RATIO = 1.5
KEY_BITS = 56
#: Sets of a stretch that may share a key before they are tied together unseen, and sets of a part of a list.
HOT = 64
LISTED = 4096
#: Keys sorted and packed at once, and shingles counted at once: they bound a task's memory.
PACKED_KEYS = 400_000
COUNTED = 1 << 20
#: A stretch of COUNTED shingles reports those in four sets or more; common is what has 2**-17 of all incidences.
REPORTED = 4
COMMON_BITS = 17
COMMON_AT_LEAST = 64
#: How often parts are cut with another seed before single shingles become keys.
SEEDS = 3
#: Nodes of sets that no document with an id has.
NO_ID = 1 << 62


class Shingles:
    def __init__(self, n: int):
        self.n, self.of_bytes, self.of_words, self.values = n, tx.Rolling(tx.BASE_A), tx.Rolling(tx.BASE_B), tx.byte_values(5)

    def sets(self, text: pa.Array):
        """(row, sorted distinct shingle hashes) of each text."""
        for row, rows, data, off in tx.pieces(text, PIECE):
            data = tx.LOWER[data]
            s, e, woff = tx.words(data, off, tx.BLANK_WORDS)
            h = self.of_bytes.span(self.of_bytes.prefix(self.values[data]), s, e)
            prefix = self.of_words.prefix(h)
            size = np.diff(woff)
            count = np.where(size >= self.n, size - self.n + 1, np.minimum(size, 1))
            lo = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(woff[:-1], count)
            hashes = self.of_words.span(prefix, lo, lo + np.repeat(np.minimum(size, self.n), count))
            at = np.r_[0, np.cumsum(count)]
            for d in range(rows):
                x = np.sort(hashes[at[d] : at[d + 1]])
                yield row + d, x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def set_keys(x: np.ndarray) -> tuple[int, int]:
    """Two 64-bit names of a set."""
    return int(x.sum(dtype=np.uint64).astype(np.int64)), int(tx.mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64))


def most_apart(n: int, m: int, percent: int) -> int:
    """In how many shingles sets of n and m can differ and still link."""
    return (n + m) * (100 - percent) // (100 + percent)


@lru_cache
def single_top(percent: int) -> int:
    """The largest size up to which partners hold one shingle at most that the other lacks."""
    top = 1
    while True:
        n = top + 1
        for m in range(n * percent // 100, n + 1):
            shared = -(-percent * (n + m) // (100 + percent))
            if shared <= m and n - shared > 1:
                return top
        top = n


@lru_cache(4096)
def tops(percent: int, upto: int) -> list[int]:
    """The largest size of each class, for sizes to ``upto``; the first class has keys of its own."""
    out = [single_top(percent)]
    while out[-1] < upto:
        out.append(max(out[-1] + 1, int(out[-1] * CLASS_RATIO)))
    return out


def named(values: np.ndarray, seed: int) -> np.ndarray:
    return tx.mix(values ^ tx.mix(np.full(1, seed, np.uint64))[0])


def cut(x: np.ndarray, rare: np.ndarray, parts: int, seed: int):
    """(names, sizes) of the filled parts, those with most rare shingles first: one order for all sets."""
    h = named(x, seed)
    part = (((h >> tx.U64(32)) * tx.U64(parts)) >> tx.U64(32)).astype(np.int64)
    total = np.zeros(parts, np.uint64)
    np.add.at(total, part, tx.mix(h))
    size, weight = np.bincount(part, minlength=parts), np.bincount(part, rare, minlength=parts)
    names = named(total ^ tx.mix(np.arange(parts, dtype=np.uint64)), 1000 + seed)
    order = np.lexsort((names, -size, -weight))
    return names[order[size[order] > 0]]


def keys_of(x: np.ndarray, percent: int, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The keys of a set. common: common shingles, sorted; often: how many sets hold each."""
    n = len(x)
    largest = n * 100 // percent
    limit = tops(percent, largest)
    seen = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, x), len(common) - 1)
        seen = np.where(common[at] == x, often[at], 0)
    rare = seen == 0
    out = []
    if n <= limit[0]:
        if 100 * n >= percent * (n + 1):  # sets below this link with equal ones only
            each = tx.mix(x)
            total = each.sum(dtype=np.uint64)
            out.append(named(np.r_[total, total - each], 7))
    for c in range(1, len(limit)):
        if limit[c] < n:
            continue
        apart = most_apart(limit[c], limit[c], percent)
        need = most_apart(n, min(limit[c], largest), percent) + 1
        found = 0
        for seed in range(SEEDS):
            use = rare if seed < SEEDS - 1 else np.ones(n, bool)
            names = cut(x[use], rare[use], apart + 1, c * 10 + seed)[:need] if use.any() else x[:0]
            out.append(names)
            found = len(names)
            if found == need:
                break
        if found < need:
            order = np.lexsort((x, seen))
            out.append(named(x[order[: most_apart(n, largest, percent) + 1]], c * 10 + 9))
    return np.concatenate(out) if out else x[:0]


def sketch(x: np.ndarray) -> bytes:
    """How many shingles fall in each of 2**k equal ranges, two counts (15 at most) a byte; k grows with the set."""
    bits = max(6, min(12, int(len(x) - 1).bit_length() - 2))
    counts = np.minimum(np.bincount((x >> tx.U64(64 - bits)).astype(np.int64), minlength=1 << bits), 15).astype(np.uint8)
    return tx.blob(counts[0::2] | counts[1::2] << 4)


def alike(names: np.ndarray, sizes: np.ndarray, sketches: list[bytes], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose sizes and sketches allow a link."""
    width = np.array([len(s) for s in sketches])
    levels = {}
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        held = np.frombuffer(b"".join(sketches[i] for i in rows), np.uint8).reshape(len(rows), w)
        levels[w] = rows, np.stack([held & 15, held >> 4], 2).reshape(len(rows), -1).view(np.int8)
    fold = lambda m: m[..., 0::2] + m[..., 1::2]
    place = np.zeros(len(names), np.int64)
    for rows, _ in levels.values():
        place[rows] = np.arange(len(rows))
    left, out = np.ones(len(names), bool), []

    def near(i: int) -> np.ndarray:
        ok = left & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
        own = levels[width[i]][1][place[i]]
        for w, (rows, held) in levels.items():
            on = ok[rows]
            if not on.any() or max(w, width[i]) > 2 * min(w, width[i]):  # too far apart to compare: nothing is ruled out
                continue
            some = np.flatnonzero(on)
            step = max(1, COMPARED // held.shape[1])
            for k in range(0, len(some), step):
                few = some[k : k + step]
                a, b = (fold(held[few]), own) if w > width[i] else (held[few], fold(own) if w < width[i] else own)
                apart = np.abs(a - b).sum(1)
                ok[rows[few]] = apart <= (sizes[i] + sizes[rows[few]]) * (100 - percent) // (100 + percent)
        return np.flatnonzero(ok)

    for root in range(len(names)):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue and left.any():
            found = near(queue.pop())
            left[found] = False
            out += [(int(names[root]), int(names[j])) for j in found]
            queue.extend(found.tolist())
    return out


META = "doc_id {kind}, t1 long, t2 long, s1 long, s2 long, n long, sketch binary, common binary"


def described(n: int):
    """A row for each document; and rows (n = -1) of the shingles that came up often in a stretch of different sets."""

    def counted(sets):
        values, counts = np.unique(np.concatenate(sets), return_counts=True)
        on = counts >= REPORTED
        return tx.blob(np.stack([values[on], counts[on].astype(np.uint64)]))

    def run(batches):
        shingles = Shingles(n)
        sets, names, held, schema = [], set(), 0, None

        def reported():
            cols = {"common": pa.array([counted(sets)], pa.binary()), "n": pa.array([-1], pa.int64())}
            return pa.RecordBatch.from_arrays([cols.get(f.name, pa.nulls(1, f.type)) for f in schema], schema=schema)

        for batch in batches:
            found = []
            for _, x in shingles.sets(batch.column("text")):
                name = set_keys(x)
                found.append((*name, len(x), sketch(x) if len(x) else None))
                if len(x) and name not in names:
                    names.add(name)
                    sets.append(x)
                    held += len(x)
            cols = list(zip(*found, strict=True)) or [[]] * 4
            out = pa.RecordBatch.from_pydict(
                {k: batch.column(k) for k in ("doc_id", "t1", "t2")}
                | {k: pa.array(v, pa.int64()) for k, v in zip(("s1", "s2", "n"), cols, strict=False)}
                | {"sketch": pa.array(cols[3], pa.binary()), "common": pa.nulls(len(found), pa.binary())}
            )
            schema = out.schema
            yield out
            if held >= COUNTED:
                yield reported()
                sets, names, held = [], set(), 0
        if sets:
            yield reported()

    return run


def unrolled(batches):
    for batch in batches:
        for held in batch.column("common").to_pylist():
            values, counts = np.frombuffer(held, np.int64).reshape(2, -1)
            yield pa.RecordBatch.from_pydict({"shingle": pa.array(values), "sets": pa.array(counts)})


def common_shingles(every: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, sets that hold each) of the shingles with 2**-17 of all incidences or more: 2**17 at most.

    They only order keys, so a shingle left out costs time and loses nothing.
    """
    mass = every.where("n > 0").agg(F.sum("n")).first()[0] or 0
    least = max(COMMON_AT_LEAST, mass >> COMMON_BITS)
    sums = every.where("n < 0").select("common").mapInArrow(unrolled, "shingle long, sets long").groupBy("shingle").agg(F.sum("sets").alias("sets"))
    rows = sums.where(F.col("sets") >= least).collect()
    values = np.array([r["shingle"] for r in rows], np.int64).astype(np.uint64)
    order = np.argsort(values)
    return values[order], np.array([r["sets"] for r in rows], np.int64)[order]


FILED = "bucket int, keys binary, sets binary, tied boolean"


def filed(n: int, percent: int, n_buckets: int, common: np.ndarray, often: np.ndarray):
    """Keys of each bucket with a set each, apart (tied) those that very many sets hold here: one set stands for them there, and links (no keys) tie the others to it."""
    drop = tx.U64(64 - KEY_BITS)

    def rows_of(keys, sets, tied):
        bounds = tx.run_bounds(b := tx.bucket_of(keys, n_buckets))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if hi > lo:
                yield int(b[lo]), tx.pack(np.diff(keys[lo:hi] >> drop, prepend=tx.U64(0))), tx.blob(sets[lo:hi]), tied

    def packed(keys, sets):
        keys, sets = np.concatenate(keys), np.concatenate(sets)
        order = np.lexsort((sets, keys))
        keys, sets = keys[order], sets[order]
        first = np.r_[True, keys[1:] != keys[:-1]]
        of = np.cumsum(first) - 1
        hot = (np.bincount(of) > HOT)[of]
        rows = list(rows_of(keys[~hot], sets[~hot], False))
        if hot.any():
            rows += rows_of(keys[hot & first], sets[hot & first], True)
            links = np.unique(np.stack([sets, sets[np.flatnonzero(first)][of]], 1)[hot & ~first], axis=0)
            rows.append((-1 - int(links[0, 0]) % n_buckets, b"", tx.blob(links), True))
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(4)], ["bucket", "keys", "sets", "tied"])

    def run(batches):
        shingles = Shingles(n)
        keys, sets, names, held = [], [], set(), 0
        for batch in batches:
            for _, x in shingles.sets(batch.column("text")):
                name = set_keys(x)[0]
                if not len(x) or name in names:
                    continue
                names.add(name)
                k = np.unique(keys_of(x, percent, common, often))
                keys.append(k)
                sets.append(np.full(len(k), name))
                held += len(k)
                if held >= PACKED_KEYS:
                    yield packed(keys, sets)
                    keys, sets, names, held = [], [], set(), 0
        if held:
            yield packed(keys, sets)

    return run


MET = "a long, b long, tied boolean"


def met(batches):
    """Each set of a key (a) with the least set of it (b); tied if they belong together unseen."""
    keys, sets, tied, links = [], [], [], []
    for batch in batches:
        for k, s, t in zip(*(batch.column(c).to_pylist() for c in ("keys", "sets", "tied")), strict=True):
            if k:
                keys.append(np.cumsum(tx.unpack(k), dtype=np.uint64))
                sets.append(np.frombuffer(s, np.int64))
                tied.append(np.full(len(sets[-1]), t))
            else:
                links.append(np.c_[np.frombuffer(s, np.int64).reshape(-1, 2), np.ones(len(s) // 16, np.int64)])
    if keys:
        keys, sets, tied = map(np.concatenate, (keys, sets, tied))
        order = np.lexsort((sets, keys))
        keys, sets, tied = keys[order], sets[order], tied[order]
        first = np.r_[True, keys[1:] != keys[:-1]]
        of = np.cumsum(first) - 1
        least, tied = sets[np.flatnonzero(first)][of], np.bincount(of, tied)[of] > 0
        links.append(np.stack([sets, least, tied], 1)[sets != least])
    if links:
        found = np.unique(np.concatenate(links), axis=0)
        yield pa.RecordBatch.from_pydict({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1]), "tied": pa.array(found[:, 2] > 0)})


def parted(percent: int):
    """Rows sorted by list (and part of it): what stays together on it."""

    def run(batches):
        rows, now = [], None

        def ended():
            edges = alike(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), [r[2] for r in rows], percent)
            return pa.RecordBatch.from_pydict({k: pa.array([e[i] for e in edges], pa.int64()) for i, k in enumerate("ab")})

        for batch in batches:
            for part, *row in zip(*(batch.column(k).to_pylist() for k in ("part", "x", "n", "sketch")), strict=True):
                if part != now:
                    if rows:
                        yield ended()
                    rows, now = [], part
                rows.append(row)
        if rows:
            yield ended()

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of two blocks, added up slab by slab over the shingles that both have."""
    lv, rv = np.concatenate(left), None if left is right else np.concatenate(right)
    both = np.unique(lv) if rv is None else np.intersect1d(lv, rv)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(both):
        return out

    def placed(values, sets):
        """(sets, places in both) of the shingles that are there, by place."""
        of = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(both, values), len(both) - 1).astype(np.int32)
        on = both[at] == values
        of, at = of[on], at[on]
        order = np.argsort(at, kind="stable")
        return of[order], at[order]

    lw, at = placed(lv, left)
    rw, bt = (lw, at) if rv is None else placed(rv, right)
    for k in range(0, len(both), SLAB):
        width = min(SLAB, len(both) - k)
        s, t = slice(*np.searchsorted(at, [k, k + width])), slice(*np.searchsorted(bt, [k, k + width]))
        a = np.zeros((len(left), width), np.float32)
        a[lw[s], at[s] - k] = 1
        b = a
        if rv is not None:
            b = np.zeros((len(right), width), np.float32)
            b[rw[t], bt[t] - k] = 1
        out += a @ b.T
    return out


class Block:
    """Sets that meet others: their nodes, names, copies, and shingles one set after the other."""

    def __init__(self, node, name, copies, sets):
        self.node, self.name, self.copies = (np.asarray(v, np.int64) for v in (node, name, copies))
        self.sets = sets
        self.size = np.array([len(x) for x in sets], np.int64)

    def packed(self) -> tuple[bytes, int, bytes]:
        """(nodes, names and copies; length; compressed shingles): distinct shingles once, sets as rising indices."""
        values, at = np.unique(np.concatenate(self.sets), return_inverse=True)
        starts = np.r_[0, np.cumsum(self.size)[:-1]]
        step = at.astype(np.int64).ravel()
        step[1:] = np.diff(step)
        step[starts] = at.ravel()[starts]
        pieces = [tx.pack(self.size), tx.pack(np.diff(values, prepend=tx.U64(0))), tx.pack(step)]
        raw = b"".join(len(p).to_bytes(8, "little") + p for p in pieces)
        return tx.blob(np.stack([self.node, self.name, self.copies])), len(raw), pa.compress(raw, codec="zstd", asbytes=True)

    @classmethod
    def unpacked(cls, about: bytes, length: int, held: bytes) -> Block:
        raw = pa.decompress(held, decompressed_size=length, codec="zstd", asbytes=True)
        pieces = []
        while raw:
            size = int.from_bytes(raw[:8], "little")
            pieces.append(tx.unpack(raw[8 : 8 + size]))
            raw = raw[8 + size :]
        size, values, step = pieces
        values, ends = np.cumsum(values, dtype=np.uint64), np.cumsum(size).astype(np.int64)
        sets = [values[np.cumsum(step[lo:hi]).astype(np.int64)] for lo, hi in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)]
        return cls(*np.frombuffer(about, np.int64).reshape(3, -1), sets)


def linked(left: Block, right: Block, percent: int):
    """Links of two blocks (or of one with itself, if left is right): (forest edges, (name, links) of both sides)."""
    n, m = left.size[:, None], right.size[None, :]
    fits = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    if left is right:
        fits &= left.name[:, None] != right.name[None, :]
    if not fits.any():
        return [], []
    shared = overlaps(left.sets, right.sets).astype(np.int64)
    yes = fits & (100 * shared >= percent * (n + m - shared))
    counts = [(left.name, (yes * right.copies[None, :]).sum(1))]
    if left is not right:
        counts.append((right.name, (yes * left.copies[:, None]).sum(0)))
    edges, open_rows = [], yes.any(1)
    while open_rows.any():  # a tree for each connected part
        root = int(np.flatnonzero(open_rows)[0])
        rows = np.zeros(len(yes), bool)
        rows[root] = True
        front, cols = rows.copy(), np.zeros(yes.shape[1], bool)
        while front.any():
            cols |= yes[front].any(0)
            front = (cols if left is right else yes[:, cols].any(1)) & ~rows
            rows |= front
        edges += [(left.node[root], left.node[i]) for i in np.flatnonzero(rows) if i != root]
        if left is not right:
            edges += [(left.node[root], right.node[i]) for i in np.flatnonzero(cols)]
        open_rows &= ~rows
    return edges, [(s[k], c[k]) for s, c in counts for k in np.flatnonzero(c)]


def link_rows(found, every_link: bool, **more) -> pa.RecordBatch:
    """a, b: nodes of a link; or s1 and its number of links."""
    edges, counts = found
    counts = counts if every_link else []
    a, b = [int(e[0]) for e in edges] + [None] * len(counts), [int(e[1]) for e in edges] + [None] * len(counts)
    s, c = [None] * len(edges) + [int(k[0]) for k in counts], [None] * len(edges) + [int(k[1]) for k in counts]
    cols = {k: pa.array(v, pa.int64()) for k, v in (("a", a), ("b", b), ("s1", s), ("links", c))}
    return pa.RecordBatch.from_pydict(cols | {k: pa.nulls(len(a), kind) for k, kind in more.items()})


PLACE = ("grp", "c", "blk")
LINKS = "a long, b long, s1 long, links long"
BLOCKS = f"{LINKS}, grp long, c int, blk int, about binary, length long, held binary"


def within(n: int, percent: int, every_link: bool):
    """Rows sorted by block: the links within each, and the packed block if its group has several."""
    packed_columns = {"grp": pa.int64(), "c": pa.int32(), "blk": pa.int32(), "about": pa.binary(), "length": pa.int64(), "held": pa.binary()}

    def ended(place, rows, several):
        rows = list({r[0]: r for r in sorted(rows, key=lambda r: not r[4])}.values())  # a set that is shown to its own block counts once
        block = Block([r[1] for r in rows], [r[0] for r in rows], [r[2] for r in rows], [r[3] for r in rows])
        yield link_rows(linked(block, block, percent), every_link, **packed_columns)
        if several:
            own = [r for r in rows if not r[4]]
            if own:
                about, length, held = Block([r[1] for r in own], [r[0] for r in own], [r[2] for r in own], [r[3] for r in own]).packed()
                cols = dict.fromkeys(("a", "b", "s1", "links"), pa.nulls(1, pa.int64()))
                row = dict(zip(PLACE, place, strict=True)) | {"about": about, "length": length, "held": held}
                yield pa.RecordBatch.from_pydict(cols | {k: pa.array([row[k]], kind) for k, kind in packed_columns.items()})

    def run(batches):
        shingles, rows, names, now, several = Shingles(n), [], set(), None, False
        for batch in batches:
            held = [batch.column(k).to_pylist() for k in (*PLACE, "s1", "node", "copies", "several", "shown")]
            for i, x in shingles.sets(batch.column("text")):
                grp, c, b, name, node, copies, many, shown = (v[i] for v in held)
                if (grp, c, b) != now:
                    if rows:
                        yield from ended(now, rows, several)
                    rows, names, now, several = [], set(), (grp, c, b), many
                if (name, shown) not in names:
                    names.add((name, shown))
                    rows.append((name, node, copies, x, shown))
        if rows:
            yield from ended(now, rows, several)

    return run


def meetings(percent: int, every_link: bool):
    """Rows sorted by meeting, two blocks each: their links."""

    def run(batches):
        now, first = None, None
        for batch in batches:
            for meeting, *block in zip(*(batch.column(k).to_pylist() for k in ("meeting", "about", "length", "held")), strict=True):
                if meeting != now:
                    now, first = meeting, block
                else:
                    yield link_rows(linked(Block.unpacked(*first), Block.unpacked(*block), percent), every_link)

    return run


def candidates(docs: DataFrame, n: int, percent: int, common=(np.zeros(0, np.uint64), np.zeros(0, np.int64))) -> DataFrame:
    """a, b, tied: names of sets and of the lists they are on."""
    nb = buckets(docs.sparkSession)
    return docs.select("text").mapInArrow(filed(n, percent, nb, *common), FILED).repartition("bucket").mapInArrow(met, MET).distinct()


def together(found: DataFrame, every: DataFrame, percent: int) -> DataFrame:
    """node, root: the groups of sets. found: rows of candidates; every: s1, n and sketch of each document."""
    found = settled(found)
    tied = found.where("tied").select("a", "b")
    lists = settled(found.where("not tied").select(F.col("b").alias("list"), F.col("a").alias("x")).union(found.where("not tied").select("b", "b")).distinct())
    names = settled(lists.select(F.col("x").alias("s1")).distinct())
    listed = sieve.sifted(every.where("n > 0").select("s1", "n", "sketch"), "s1", sieve.table_of(names))
    held = settled(listed.join(names, "s1", "left_semi").groupBy(F.col("s1").alias("x")).agg(F.max("n").alias("n"), F.max("sketch").alias("sketch")))
    large = settled(lists.groupBy("list").agg(F.count("*").alias("size")).where(F.col("size") > LISTED).select("list", F.ceil(F.col("size") / LISTED).cast("int").alias("parts")))
    placed = lists.join(large, "list", "left").withColumn("mine", F.coalesce(F.pmod(F.xxhash64("x"), F.col("parts")), F.lit(0)).cast("int"))
    # the set that a list is named by is on every part of it
    several = F.when(F.col("parts").isNotNull() & (F.col("x") == F.col("list")), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("mine"))
    look = lambda rows: settled(rows.join(held, "x").select("part", "x", "n", "sketch").repartition("part").sortWithinPartitions("part", "x").mapInArrow(parted(percent), "a long, b long"))
    edges = tied.union(look(placed.select("x", F.explode(several).alias("p"), "list").select("x", F.struct("list", "p", F.lit(0).alias("q")).alias("part"))))
    if not large.isEmpty():  # parts meet where a list isn't one group yet
        roots = components(edges)
        apart = lists.join(large, "list").join(roots, F.col("x") == F.col("node"), "left").groupBy("list").agg(F.min(F.coalesce("root", "x")).alias("lo"), F.max(F.coalesce("root", "x")).alias("hi")).where("lo <> hi").select("list")
        others = placed.join(apart, "list", "left_semi").select("x", "list", "mine", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"))
        edges = edges.union(look(others.select("x", F.struct("list", F.least("mine", "p").alias("p"), F.greatest("mine", "p").alias("q")).alias("part"))))
    groups = components(edges)
    discard(found, lists, names, held, large)
    return groups


def dealt(members: DataFrame, percent: int, every_link: bool) -> tuple[DataFrame, DataFrame]:
    """(a row for each block that a set is in or shown to; the blocks of each group that has several: grp, blocks).

    members: grp, s1, n and others. A group of one block has block 0 of class 0.
    """
    size_class = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent))).cast("int")
    own = members.withColumn("c", size_class)
    by_class = own.groupBy("grp", "c").agg(F.count("*").alias("size"), F.sum("n").alias("mass"), F.min_by("s1", F.xxhash64("s1")).alias("hub"))
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("mass") / BLOCK_SHINGLES)).cast("int")
    groups = by_class.groupBy("grp").agg(F.sum("size").alias("size"), F.sum("mass").alias("mass"), F.map_from_entries(F.collect_list(F.struct("c", blocks))).alias("blocks"), F.collect_list("hub").alias("hubs"))
    large = settled(groups.where((F.col("size") > BLOCK) | (F.col("mass") > BLOCK_SHINGLES)).select("grp", "blocks", "hubs"))
    placed = own.join(large, "grp", "left").withColumn("several", F.col("blocks").isNotNull())
    mine = F.pmod(F.xxhash64("s1"), F.try_element_at("blocks", "c")).cast("int")
    at = lambda c, b, shown: F.struct(c.cast("int").alias("c"), b.cast("int").alias("blk"), shown.alias("shown"))
    place = F.when(F.col("several"), F.array(at(F.col("c"), mine, F.lit(False)))).otherwise(F.array(at(F.lit(0), F.lit(0), F.lit(False))))
    if not every_link:  # one set of each class is shown to the blocks of the classes about it
        near = F.filter(F.map_entries("blocks"), lambda e: F.abs(e["key"] - F.col("c")) <= 1)
        everywhere = F.flatten(F.transform(near, lambda e: F.transform(F.sequence(F.lit(0), e["value"] - 1), lambda b: at(e["key"], b, F.lit(True)))))
        place = F.when(F.col("several") & F.array_contains("hubs", F.col("s1")), F.concat(place, everywhere)).otherwise(place)
    return placed.select(*members.columns, "several", F.explode(place).alias("p")).select("*", "p.*").drop("p"), large.select("grp", "blocks")


def cross(packed: DataFrame, large: DataFrame) -> DataFrame:
    """A row for each meeting of two blocks that a packed block takes part in."""
    name = lambda c, b: c.cast("bigint") * F.lit(1 << 32).cast("bigint") + b
    mine = name(F.col("c"), F.col("blk"))
    near = F.filter(F.map_entries("blocks"), lambda e: F.abs(e["key"] - F.col("c")) <= 1)
    others = F.filter(F.flatten(F.transform(near, lambda e: F.transform(F.sequence(F.lit(0), e["value"] - 1), lambda b: name(e["key"], b)))), lambda o: o != mine)
    met_in = packed.join(large, "grp").withColumn("o", F.explode(others))
    return met_in.select("grp", F.least(mine, "o").alias("lo"), F.greatest(mine, "o").alias("hi"), "about", "length", "held").withColumn("meeting", F.struct("grp", "lo", "hi"))


def linked_sets(docs: DataFrame, n: int, percent: int, every_link: bool) -> tuple[DataFrame, DataFrame]:
    """(described documents with their id key; sets: s1, s2, copies, root, n_links, and whether the set is alone)."""
    id_key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID).cast("bigint"))
    kind = dict(docs.dtypes)["doc_id"]
    known = docs.select("doc_id", *rp.text_keys(), "text")
    every = settled(known.mapInArrow(described(n), META.format(kind=kind)))
    common = common_shingles(every)
    every = every.where("n >= 0").drop("common").withColumn("id", id_key)
    least = F.min("id")
    sets = settled(
        every.where("n > 0").groupBy("s1", "s2").agg(least.alias("id"), F.min_by("t1", "id").alias("t1"), F.min_by("t2", "id").alias("t2"), F.max("n").alias("n"), F.count("*").alias("copies"))
        .withColumn("node", F.when(F.col("id") < NO_ID, F.col("id")).otherwise(F.lit(NO_ID).cast("bigint") + F.shiftrightunsigned("s1", 2)))
    )
    groups = together(candidates(docs.where("text is not null"), n, percent, common), every, percent)
    members = settled(sets.join(groups.select(F.col("node").alias("s1"), F.col("root").alias("grp")), "s1"))
    placed, large = dealt(members, percent, every_link)
    placed = settled(placed.select(*PLACE, "s1", "node", "copies", "several", "shown", "t1", "t2", "id"))
    wanted = sieve.table_of(placed.select("t1"))
    texts = sieve.sifted(known.select(id_key.alias("id"), "t1", "t2", "text"), "t1", wanted).join(placed, ["t1", "t2", "id"])
    texts = texts.select(*PLACE, "s1", "node", "copies", "several", "shown", "text").repartition(*PLACE).sortWithinPartitions(*PLACE)
    first = settled(texts.mapInArrow(within(n, percent, every_link), BLOCKS))
    links, packed = first.where("grp is null").select("a", "b", "s1", "links"), first.where("grp is not null").select(*PLACE, "about", "length", "held")
    if not every_link:
        roots = components(links.select("a", "b"))
        apart = members.join(large.select("grp"), "grp", "left_semi").join(roots, "node", "left").groupBy("grp").agg(F.min(F.coalesce("root", "node")).alias("lo"), F.max(F.coalesce("root", "node")).alias("hi"))
        large = settled(large.join(apart.where("lo <> hi"), "grp", "left_semi"))
    if not large.isEmpty():
        met_rows = cross(packed, large).repartition("meeting").sortWithinPartitions("meeting")
        links = links.union(settled(met_rows.mapInArrow(meetings(percent, every_link), LINKS)))
    edges = links.where("a is not null").select("a", "b")
    twice = settled(every.where(f"n > 0 and id < {NO_ID}").groupBy("id").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).where("lo <> hi").select("id"))
    if not twice.isEmpty():  # ids with different texts tie their sets together
        edges = edges.union(every.where("n > 0").join(twice, "id").select("id", "s1").join(sets.select("s1", "node"), "s1").select("node", "id"))
    roots = components(edges).select("node", "root")
    counts = links.where("s1 is not null").groupBy("s1").agg(F.sum("links").alias("links"))
    joined = sets.join(roots, "node", "left").join(counts, "s1", "left")
    rooted = settled(joined.select("s1", "s2", "copies", F.col("root").isNull().alias("alone"), F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    discard(sets, members, placed, first)
    return every, rooted


def join(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, n_links (documents it links with, copies included)."""
    every, sets = linked_sets(docs, n, percent, True)
    kind = dict(docs.dtypes)["doc_id"]
    tagged = every.where("n > 0").join(sets, ["s1", "s2"])
    linked_docs = tagged.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root") < NO_ID, F.col("root")).cast(kind).alias("component_id"), "n_links")
    rest = every.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("bigint").alias("n_links"))
    return linked_docs.union(rest)


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents' own columns, one row of each group of linked documents: that with the least doc_id.

    Of rows with that id, the one with the least text hashes stays, and of equal rows one; a group without any
    id keeps one row too. Documents without words all stay.
    """
    every, sets = linked_sets(docs, n, percent, False)
    busy = sets.where("copies > 1 or not alone").select("s1", "s2", "root")
    narrow = settled(every.where("n > 0").join(busy, ["s1", "s2"]).select("id", "t1", "t2", "root"))
    is_head = (F.col("id") == F.col("root")) | (F.col("root") >= NO_ID)
    heads = settled(narrow.where(is_head).groupBy("root", "id", "t1", "t2").agg(F.count("*").alias("rows")))
    best = heads.groupBy("root").agg(F.min(F.struct("t1", "t2")).alias("m"))
    judged = settled(heads.join(best, "root").select("id", "t1", "t2", (F.struct("t1", "t2") == F.col("m")).alias("best"), "rows"))
    # only texts whose hash may be among those that go and among those that stay are shuffled
    gone = settled(narrow.where(~is_head).select("id", "t1", "t2").union(judged.where("not best").select("id", "t1", "t2")).distinct())
    repeated = settled(judged.where("best and rows > 1").select("id", "t1", "t2"))
    t1, t2 = rp.text_keys()
    keyed = docs.select("*", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID).cast("bigint")).alias("__id"), t1.alias("__t1"), t2.alias("__t2"))
    on = lambda other: [F.col(f"__{k}") == other[k] for k in ("id", "t1", "t2")]
    stay = settled(every.select("id", "t1", "t2").join(gone, ["id", "t1", "t2"], "left_anti").select("t1"))
    goes, stays = sieve.table_of(gone.select("t1")), sieve.table_of(stay)
    unsure = sieve.sifted(keyed, "__t1", goes, stays)
    kept = sieve.sifted(keyed, "__t1", goes, inside=False).union(unsure.join(gone, on(gone), "left_anti"))
    if repeated.isEmpty():
        return kept.select(docs.columns)
    one = kept.join(repeated, on(repeated), "left_semi").groupBy("__id", "__t1", "__t2").agg(F.first(F.struct(*docs.columns)).alias("r")).select("r.*")
    return kept.join(repeated, on(repeated), "left_anti").select(docs.columns).union(one)
