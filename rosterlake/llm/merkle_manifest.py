"""A Merkle manifest of a dataset: digests up to one root, proofs down to each row.

A leaf is the SHA-256 of a row's fields. The leaves of a group (a source) are
numbered in the order of their key by a range shuffle of narrow rows and the
sizes of its parts. From a leaf's number and the group's size follow every
ancestor's number and how many children it must have, so nodes need no further
order: each one that comes up is an event that is added to its partial parent,
and a parent that has all its children is hashed and comes up in turn. What a
task can't finish (parents whose children lie in several tasks, some 15 nodes a
level for either end of its range) is its frontier; frontiers are shuffled by
stretches of leaves, each round with longer ones, until every group has its
subroot. The subroots are the leaves of one more tree of the same kind. Reverse
links, from parents to the runs of their children, then hand each run the runs
above it; a row's proof is its siblings in all of these.

Lost executors: leaves, numbers, nodes and runs are written tables. No task
holds more than its share of partial parents; a group that a third of all rows
are in is spread like any other. The driver sees the number of groups, the size
of the largest one, and the root.

Edge cases: null fields hash as "-"; null groups and keys are values that come
first; rows that share a key follow in the order of their leaves, and repeated
rows are leaves of their own; a group of one row has its leaf as subroot; an
empty table has no rows, no nodes and no root; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import settled

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree whose leaves are the subroots.
TOP = -1
#: Levels that a frontier's first stretch of leaves spans; each round adds as many.
LEVELS = 4
NODE, OPEN, ROOT = 0, 1, 2


def leaf(*values: Column) -> Column:
    """SHA-256, in hex, of the values: "-" if null, else byte count, colon, value."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def ordered(df: DataFrame, within: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """df in the order of within and order, written with lane (a task) and nth (of the task's rows of the same within), and the parts' offsets.

    An offset is a row for a lane and a value of within: l, w_..., earlier (rows in lanes before) and n (rows in all lanes).
    """
    spark = df.sparkSession
    fields = ", ".join(f"{k} {t}" for k, t in df.dtypes) + ", lane int, nth bigint"

    def count(batches):
        lane, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            new[0] = last is not None and [batch.column(k)[0].as_py() for k in within] != last
            for k in within:
                a, b = batch.column(k)[1:], batch.column(k)[:-1]
                new[1:] |= np.asarray(pc.fill_null(pc.not_equal(a, b), False)) | (np.asarray(pc.is_null(a)) != np.asarray(pc.is_null(b)))
            begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            nth = np.arange(n) - begin + np.where(np.cumsum(new) == 0, seen, 0)
            last, seen = [batch.column(k)[n - 1].as_py() for k in within], int(nth[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, lane, np.int32)), pa.array(nth)], [*batch.schema.names, "lane", "nth"])

    keys = [*within, *order]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = settled(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(count, fields))
    sizes = held.groupBy(F.col("lane").alias("l"), *[F.col(k).alias(f"w_{k}") for k in within]).agg(F.count(F.lit(1)).alias("here"))
    lanes = Window.partitionBy(*[F.col(f"w_{k}") for k in within] or [F.lit(0)])  # a row for each task
    earlier = F.sum("here").over(lanes.orderBy("l").rowsBetween(Window.unboundedPreceding, -1))
    return held, sizes.select("l", *[f"w_{k}" for k in within], F.coalesce(earlier, F.lit(0)).alias("earlier"), F.sum("here").over(lanes).alias("n"))


def climber(arity: int):
    """Adds nodes to their partial parents; a parent that has all its children comes up as a node. Left over: the children of partial parents."""

    def climb(batches):
        partial: dict[tuple[int, int, int], dict[int, bytes]] = {}
        for batch in batches:
            out = []
            for tree, n, level, idx, digest in zip(*(batch.column(k).to_pylist() for k in ("tree", "n", "level", "idx", "digest")), strict=True):
                size = -(-n // arity**level)
                while size > 1:
                    parent, place = divmod(idx, arity)
                    children = partial.setdefault((tree, n, level, parent), {})
                    children[place] = digest
                    if len(children) < min(arity, size - parent * arity):
                        break
                    del partial[tree, n, level, parent]
                    digest = sha256("".join(children[k].hex() for k in range(len(children))).encode()).digest()
                    level, idx, size = level + 1, parent, -(-size // arity)
                    out.append((tree, n, level, idx, digest, NODE))
                else:
                    out.append((tree, n, level, 0, digest, ROOT))
            yield nodes_of(out)
        left = [(tree, n, level, parent * arity + place, digest, OPEN) for (tree, n, level, parent), children in partial.items() for place, digest in children.items()]
        for k in range(0, len(left), 10_000):
            yield nodes_of(left[k : k + 10_000])

    return climb


_NODE = pa.schema([("tree", pa.int64()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.binary()), ("kind", pa.int32())])
_NODE_SQL = "tree bigint, n bigint, level int, idx bigint, digest binary, kind int"


def nodes_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, _NODE.types, strict=True)], schema=_NODE)


def grown(leaves: DataFrame, arity: int) -> DataFrame:
    """All nodes above the leaves (tree, n, idx, digest), and each tree's root."""
    start = leaves.select("tree", "n", F.lit(0).alias("level"), "idx", "digest")
    rounds = [settled(start.mapInArrow(climber(arity), _NODE_SQL))]
    span = LEVELS
    while not (frontier := rounds[-1].where(F.col("kind") == OPEN)).isEmpty():
        stretch = F.floor(F.col("idx") * F.pow(F.lit(float(arity)), F.col("level") - span))
        rounds.append(settled(frontier.repartition("tree", stretch).select("tree", "n", "level", "idx", "digest").mapInArrow(climber(arity), _NODE_SQL)))
        span += LEVELS
    return reduce(DataFrame.unionAll, rounds).where(F.col("kind") != OPEN)


@dataclass
class Manifest:
    """leaves: a row's tree, n (leaves of it), idx, key, digest. nodes: what is above, but the roots, and the tree of subroots. groups: tree, its group, its size. root: in hex."""

    leaves: DataFrame
    nodes: DataFrame
    groups: DataFrame
    root: str | None
    n_groups: int
    largest: int
    arity: int


def build(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, arity: int = ARITY, offered: Column | None = None) -> Manifest:
    """The manifest of all rows. arity: 255 at most. offered: the leaf that a row offers for proof instead of its own, in hex (null: its own)."""
    own = leaf(*[F.col(f"`{k}`") for k in fields])
    other = F.lit(None).cast("string") if offered is None else offered
    rows = settled(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{group}`").alias("its"), F.unhex(own).alias("digest"), F.unhex(other).alias("offered")))
    held, offsets = ordered(rows, ["its"], ["key", "digest"])
    offsets = settled(offsets)
    named, places = ordered(offsets.groupBy(F.col("w_its").alias("its")).agg(F.max("n").alias("size")), [], ["its"])
    groups = settled(named.join(places, named["lane"] == places["l"]).select((F.col("earlier") + F.col("nth")).alias("tree"), "its", "size"))
    found = groups.agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("largest")).first()
    begins = settled(offsets.join(groups, F.col("w_its").eqNullSafe(groups["its"])).select("l", "w_its", "earlier", "tree", "n"))
    leaves = held.join(begins, (held["lane"] == begins["l"]) & held["its"].eqNullSafe(begins["w_its"]))
    leaves = leaves.select("tree", "n", (F.col("earlier") + F.col("nth")).alias("idx"), "key", "digest", "offered")
    below = grown(leaves, arity)
    subroots = below.where(F.col("kind") == ROOT).select(F.lit(TOP).cast("bigint").alias("tree"), F.lit(found["n"]).cast("bigint").alias("n"), F.col("tree").alias("idx"), "digest")
    above = grown(subroots, arity)
    root = above.where(F.col("kind") == ROOT).select(F.lower(F.hex("digest"))).first()  # one row
    nodes = reduce(DataFrame.unionAll, [x.where(F.col("kind") == NODE).select("tree", "n", "level", "idx", "digest") for x in (below, above)])
    nodes = nodes.unionAll(subroots.select("tree", "n", F.lit(0).alias("level"), "idx", "digest"))
    return Manifest(leaves, nodes, groups, root[0] if root else None, found["n"], found["largest"] or 0, arity)


def height(n: int, arity: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


def _byte(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("int")), 2, "0"))


def below_runs(here: DataFrame, runs: DataFrame | None, starts: DataFrame, level: int, arity: int) -> DataFrame:
    """Adds `above` to runs of this level: one entry for each run above, upwards, of two bytes (its length, the place in it) and its digests.

    runs: the runs of the level above, with theirs. starts: of each tree, what is above its root.
    """
    crown = F.col("n") <= arity ** (level + 1)  # one run: its parent is the root
    out = here.where(crown).join(starts.withColumnRenamed("tree", "of"), F.col("tree") == F.col("of")).drop("of")
    if runs is None:
        return out
    upper = runs.select(F.col("tree").alias("of"), F.col("run").alias("parents"), F.concat("many", _byte(F.lit(0))).alias("head"), F.col("kids").alias("k"), F.col("above").alias("a"), F.col("many").alias("m"))
    at = here.where(~crown).join(upper, (F.col("tree") == F.col("of")) & (F.floor(F.col("run") / arity) == F.col("parents")))
    return out.unionAll(at.select(*here.columns, F.concat("m", _byte(F.pmod("run", F.lit(arity))), "k", "a").alias("above")))


def linked(made: Manifest) -> DataFrame:
    """Reverse links: the runs of leaves (tree, n, run, rows in order) with `above`. Each join goes from a run to the runs of its children."""
    arity = made.arity
    kids = F.aggregate(F.array_sort(F.collect_list(F.struct("idx", "digest"))), F.lit(b""), lambda a, x: F.concat(a, x["digest"]))
    runs = settled(made.nodes.groupBy("tree", "n", "level", F.floor(F.col("idx") / arity).alias("run")).agg(_byte(F.count(F.lit(1))).alias("many"), kids.alias("kids")))

    def down(of: DataFrame, largest: int, starts: DataFrame, last: int) -> DataFrame | None:
        upper = None
        for level in range(height(largest, arity) - 1, last - 1, -1):
            upper = below_runs(of.where(F.col("level") == level).drop("level"), upper, starts, level, arity)
        return upper

    spark = made.leaves.sparkSession
    top = down(runs.where(F.col("tree") == TOP), made.n_groups, spark.range(1).select(F.lit(TOP).cast("bigint").alias("tree"), F.lit(b"").alias("above")), 0)
    if top is None:  # one group
        starts = made.groups.select("tree", F.lit(b"").alias("above"))
    else:
        top = top.select("run", "many", "kids", "above")
        starts = made.groups.join(top, F.floor(F.col("tree") / arity) == F.col("run"))
        starts = starts.select("tree", F.concat("many", _byte(F.pmod("tree", F.lit(arity))), "kids", "above").alias("above"))
    starts = settled(starts)
    upper = down(runs.where(F.col("tree") != TOP), made.largest, starts, 1)
    rows = F.array_sort(F.collect_list(F.struct("idx", "digest", "key", "offered")))
    return below_runs(made.leaves.groupBy("tree", "n", F.floor(F.col("idx") / arity).alias("run")).agg(rows.alias("rows")), upper, starts, 0, arity)


def proofs(made: Manifest, key: str = "doc_id", with_proof: bool = False) -> DataFrame:
    """Per row: its key, leaf, subroot, root, proof_sha256 (the digest of its siblings), folded_root (from the offered leaf), verified.

    with_proof adds the proof: for each level, upwards, the place in the run and the siblings.
    """
    arity, root = made.arity, made.root
    proof = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.list_(pa.string()))]))
    fields = f"key {dict(made.leaves.dtypes)['key']}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", proof array<struct<place:int,siblings:array<string>>>" * with_proof

    def fold(digest: str, path: list[tuple[str, str]]) -> str:
        for before, after in path:
            digest = sha256((before + digest + after).encode()).hexdigest()
        return digest

    def prove(batches):
        for batch in batches:
            keys, out, held = [], [[] for _ in range(6)], []
            for rows, n, above in zip(*(batch.column(k).to_pylist() for k in ("rows", "n", "above")), strict=True):
                entries, at = [], 0
                while at < len(above):
                    many, place = above[at], above[at + 1]
                    digests = [above[k : k + 32].hex() for k in range(at + 2, at + 2 + 32 * many, 32)]
                    entries.append((place, digests))
                    at += 2 + 32 * many
                path = [("".join(d[:p]), "".join(d[p + 1 :])) for p, d in entries]
                upper = "".join(a + b for a, b in path)
                mine = [r["digest"].hex() for r in rows]
                levels = height(n, arity)
                parent = sha256("".join(mine).encode()).hexdigest() if levels else mine[0]
                subroot = fold(parent, path[: max(levels - 1, 0)])
                for p, r in enumerate(rows):
                    own = [("".join(mine[:p]), "".join(mine[p + 1 :]))] if levels else []
                    folded = fold(mine[p] if r["offered"] is None else r["offered"].hex(), own + path)
                    keys.append(r["key"])
                    for column, value in zip(out, (mine[p], subroot, root, sha256(("".join(a + b for a, b in own) + upper).encode()).hexdigest(), folded, folded == root), strict=True):
                        column.append(value)
                    if with_proof:
                        whole = [(p, mine)] * bool(levels) + entries
                        held.append([{"place": place, "siblings": digests[:place] + digests[place + 1 :]} for place, digests in whole])
            kinds = [pa.string()] * 5 + [pa.bool_()]
            columns = [pa.array(keys, batch.column("rows").type.value_type.field("key").type), *map(pa.array, out, kinds)] + [pa.array(held, proof)] * with_proof
            yield pa.RecordBatch.from_arrays(columns, ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] + ["proof"] * with_proof)

    return linked(made).select("rows", "n", "above").mapInArrow(prove, fields).withColumnRenamed("key", key)


def manifest(made: Manifest) -> DataFrame:
    """What is to be kept of a dataset: a row for each node, leaves included: group, level, idx, digest in hex; groups' subroots are the leaves of the tree without a group, whose root has its highest level."""
    hexed = F.lower(F.hex("digest")).alias("digest")
    names = made.groups.select(F.col("tree").alias("of"), F.col("its").alias("group"), F.lit(False).alias("top"))
    names = names.unionAll(made.leaves.sparkSession.range(1).select(F.lit(TOP).cast("bigint"), F.lit(None).cast(dict(made.groups.dtypes)["its"]), F.lit(True)))
    nodes = made.nodes.select("tree", "level", "idx", hexed).unionAll(made.leaves.select("tree", F.lit(0).alias("level"), "idx", hexed))
    top = made.leaves.sparkSession.createDataFrame([(TOP, height(made.n_groups, made.arity), 0, made.root)] if made.root and made.n_groups > 1 else [], "tree bigint, level int, idx bigint, digest string")
    return nodes.unionAll(top).join(names, F.col("tree") == F.col("of")).select("top", "group", "level", "idx", "digest")


def verified(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, tampered: Column | None = None, text: str = "text") -> DataFrame:
    """Per row: key, leaf, subroot, root, proof_sha256, folded_root, verified. Rows that are marked as tampered offer the leaf of their text in lower case (A-Z)."""
    other = None
    if tampered is not None:
        lowered = F.translate(F.col(f"`{text}`"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        other = F.when(tampered, leaf(*[lowered if k == text else F.col(f"`{k}`") for k in fields]))
    return proofs(build(docs, key, group, fields, offered=other), key)


def _oracle(arity: int = ARITY, levels: int = 6, tops: int = 4) -> str:
    """The query's rows in SQL, for groups of arity**levels rows and arity**tops groups: each level's nodes, their runs, and every row's way up."""
    part = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    plain, lowered = (f"sha256({' || '.join([*(part(c) for c in FIELDS[:-1]), part(text)])})" for text in ("text", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))
    out = [
        f"d AS (SELECT row_number() OVER () AS rid, doc_id, source, {plain} AS leaf, {lowered} AS lowered FROM documents)",
        "g AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM d))",
        "l AS (SELECT d.*, g.tree, row_number() OVER (PARTITION BY g.tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)",
        "a0 AS (SELECT tree, idx, leaf AS h FROM l)",
    ]

    def tree(name: str, n: int) -> None:
        for k in range(n):
            out.append(f"{name}r{k} AS (SELECT tree, idx // {arity} AS idx, list(h ORDER BY idx) AS hs FROM {name}{k} WHERE tree IN (SELECT tree FROM {name}{k} GROUP BY tree HAVING count(*) > 1) GROUP BY 1, 2)")
            out.append(f"{name}{k + 1} AS (SELECT tree, idx, sha256(array_to_string(hs, '')) AS h FROM {name}r{k})")

    tree("a", levels)
    # a tree's root is the one node of its highest level
    out.append("roots AS (SELECT tree, arg_max(h, k) AS h FROM (" + " UNION ALL ".join(f"SELECT tree, h, {k} AS k FROM a{k}" for k in range(levels + 1)) + ") GROUP BY tree)")
    out.append("b0 AS (SELECT 0 AS tree, tree AS idx, h FROM roots)")
    tree("b", tops)
    out.append("root AS (SELECT arg_max(h, k) AS root FROM (" + " UNION ALL ".join(f"SELECT h, {k} AS k FROM b{k}" for k in range(tops + 1)) + "))")
    # the way up: siblings so far, and what the row offers folded so far
    crc = f"list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT))), lambda c, x: {_crc_step()})"
    out.append(f"w0 AS (SELECT rid, doc_id, tree, idx, leaf, '' AS siblings, CASE WHEN doc_id IS NOT NULL AND xor({crc}, 4294967295) % 5 = 0 THEN lowered ELSE leaf END AS folded FROM l)")
    step, last = 0, "w0"
    for name, n in (("a", levels), ("b", tops)):
        for k in range(n):
            at, run = ("w.tree", "w.idx") if name == "a" else ("0", "w.tree")
            place = f"({run} // {arity**k}) % {arity}"
            folded = f"sha256(array_to_string(list_concat(list_append(r.hs[1 : CAST({place} AS BIGINT)], w.folded), r.hs[CAST({place} AS BIGINT) + 2 :]), ''))"
            siblings = f"w.siblings || array_to_string(list_concat(r.hs[1 : CAST({place} AS BIGINT)], r.hs[CAST({place} AS BIGINT) + 2 :]), '')"
            step += 1
            out.append(f"w{step} AS (SELECT w.rid, w.doc_id, w.tree, w.idx, w.leaf, CASE WHEN r.hs IS NULL THEN w.siblings ELSE {siblings} END AS siblings, CASE WHEN r.hs IS NULL THEN w.folded ELSE {folded} END AS folded FROM {last} w LEFT JOIN {name}r{k} r ON r.tree = {at} AND r.idx = {run} // {arity ** (k + 1)})")
            last = f"w{step}"
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, roots.h AS subroot, root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM {last} JOIN roots USING (tree), root"


def _crc_step() -> str:
    """One byte of a CRC-32 (reflected polynomial 0xEDB88320), bit by bit."""
    out = "xor(c, x)"
    for _ in range(8):
        out = f"list_transform([{out}], lambda v: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)[1]"
    return out


ORACLE = _oracle()
