"""Hard negatives, Merkle manifests and packing against plain versions, with nulls, ties, repeats and empty tables."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlake.llm import best_fit_packing as bp
from rosterlake.llm import hard_negatives as hn
from rosterlake.llm import merkle_manifest as mm
from rosterlake.llm import queries
from tests import oracle
from tests.llm import brute

TAMPERED = "crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"
here = pytest.mark.skipif(not oracle.SF.exists(), reason="the driver's tables aren't there")


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


# hard negatives


def vectors():
    """Several widths, ties, repeated rows, ids that several rows share, and one vector that a fifth of all rows have."""
    r = random.Random(1)
    rows = [(r.choice([i, i, i, 50 * (i // 50)]), r.choice([0, 1, 1, 1, 2]), [r.choice([0.0, 0.5, -0.5, r.gauss(0, 1)]) for _ in range(r.choice([8, 8, 8, 0, 3, 9]))]) for i in range(400)]
    return rows + [(100, 1, [0.5] * 8)] * 100 + [(777, 0, [300.0] * 8), (800, 0, [90000.0])]


UNUSABLE = [(None, 1, [1.0]), (1, None, [1.0]), (2, 1, None), (3, 1, [1.0, None]), (50, 1, [float("nan")]), (100, 1, [float("inf"), 1.0]), (150, 1, [-float("inf")]), (200, 1, [2e6])]


@pytest.mark.parametrize("slice_bytes", [1 << 23, 4096])
def test_hard_negatives(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(hn, "BLOCK_ROWS", 64)
    df = spark.createDataFrame([(*x, 7, [1], "clash") for x in vectors() + UNUSABLE], "vec_id long, label int, embedding array<double>, id int, vector array<int>, n string").repartition(4)
    assert ordered(hn.mine(df, slice_bytes=slice_bytes).collect()) == ordered(brute.negatives(vectors()))


def test_hard_negatives_without_rows(spark):
    df = spark.createDataFrame([(50, 1, [0.5])], "vec_id long, label int, embedding array<float>")
    assert hn.mine(df.limit(0)).count() == 0
    assert hn.mine(df).count() == 0  # an anchor without positives
    assert hn.mine(df.withColumn("vec_id", F.lit(51))).count() == 0  # no anchor


def test_bounds_hold(spark):
    """Whatever a row's cells say lies on the right side of its score, for dimensions that the sample lacks, too."""
    r = random.Random(3)
    rows = [(i, 0, [r.gauss(0, 2) for _ in range(6 if i % 9 else 7)]) for i in range(300)]
    blocks, begins = hn.index(hn.usable(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), "vec_id", "label", "embedding"), cells=8, sample_rows=40)
    q = np.array([[r.randint(-900, 900) for _ in range(7)] for _ in range(20)])
    for row in blocks.collect():
        block = hn.Block(row.asDict())
        width = block.cells.shape[1]
        low, high = block.bounds(begins, width)
        at = np.arange(width)[None, :]
        for v in q[:, :width]:
            one, two = low[at, block.cells] * v, high[at, block.cells] * v
            score = block.values.astype(np.int64) @ v
            assert (np.minimum(one, two).sum(1) <= score).all() and (score <= np.maximum(one, two).sum(1)).all()


@here
def test_hard_negatives_of_the_table(spark):
    rows = [(i, (label + 1) % 10 if i % 7 == 0 else label, v) for i, v, label in spark.read.parquet(f"{oracle.SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert ordered(queries.QUERIES["op11_hard_negatives"](spark, str(oracle.SF)).collect()) == ordered(brute.negatives(rows))


# Merkle manifest


def documents():
    """Few and many rows of a source, one row in one, null and empty sources, repeated rows and ids, 300 sources."""
    r = random.Random(2)
    rows = [(r.choice([None, i, i, i // 2]), r.choice([None, "", *["hot"] * 4, "ü", *(f"s{k}" for k in range(300))]), r.choice([None, "en"]), r.choice([None, 5]), r.choice([None, "", "Ab", f"x\n{i}", "É" * 3000])) for i in range(2500)]
    return rows + rows[:40]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*x, "a", 1.5, "b") for x in documents()], "doc_id long, source string, lang string, n_chars long, text string, digest string, idx double, key string").repartition(5).persist()


@pytest.mark.parametrize("which", ["true", "source = 'hot'", "source = 's7'", "doc_id = 8", "false"])
def test_manifest(docs, which):
    some = docs.where(which)
    want = [tuple(r)[:5] for r in some.collect()]
    assert ordered(mm.verified(some, tampered=F.expr(TAMPERED)).collect()) == ordered(brute.manifest(want) if want else [])


def test_manifest_of_another_arity(docs):
    made = mm.build(docs, arity=3)
    found = mm.proofs(made, with_proof=True).collect()
    assert [r["root"] for r in found[:1]] == [made.root] and all(r["verified"] for r in found)
    for r in found[:200]:  # the proof alone leads from the leaf to the root
        digest = r["leaf"]
        for step in r["proof"]:
            digest = brute.digest(*step["siblings"][: step["place"]], digest, *step["siblings"][step["place"] :])
        assert digest == made.root
        assert r["proof_sha256"] == brute.digest(*(x for step in r["proof"] for x in step["siblings"]))
    top = mm.manifest(made).where("top").orderBy(F.desc("level")).first()
    assert top["digest"] == made.root
    assert mm.manifest(made).where("not top and level = 0").count() == len(documents())


def test_any_change_shows(docs):
    """Rows left out, changed or moved to another source give another root."""
    root = mm.build(docs).root
    for other in (docs.where("doc_id is null or doc_id <> 8"), docs.withColumn("lang", F.when(F.col("doc_id") == 8, "de").otherwise(F.col("lang"))), docs.withColumn("source", F.when(F.col("doc_id") == 8, "hot").otherwise(F.col("source")))):
        assert mm.build(other).root != root
    assert mm.build(docs.repartition(2)).root == root


@here
def test_manifest_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{oracle.SF}/documents.parquet").select(*mm.FIELDS).collect()]
    assert ordered(queries.QUERIES["op12_merkle_manifest"](spark, str(oracle.SF)).collect()) == ordered(brute.manifest(rows))


# packing


def texts():
    r = random.Random(4)
    words = ["the", "Zwölf", "naïve", "12", "x9", "don't", "一二", "🙂", "<|endoftext|>", "", "\n", "  ", "́a"]
    rows = [(i, r.choice([" ", "  ", "\n "]).join(r.choice(words) for _ in range(r.choice([0, 1, 5, 60, 300])))) for i in range(120)]
    rows += [(200, None), (201, ""), (None, "no id"), (None, None), (202, "ab" * 9000), (203, "y " * 2047), (203, "y " * 2047), (204, "y " * 4095), (205, " " * 300000)]
    return rows


def whole(rows, capacity):
    """Every place is taken once, from 0 on, and nothing is longer than it may be; the number of sequences."""
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(held)


def plain_encoder():
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    held = tokenizers.Tokenizer.from_file(public.path(bp.TOKENIZER))
    return lambda text: held.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("capacity", "ranks"), [(2048, bp.RANKS), (64, bp.RANKS), (2048, None)])
def test_packing(spark, capacity, ranks):
    encode = plain_encoder()
    df = spark.createDataFrame([(*x, 3, "clash", 9) for x in texts()], "doc_id long, text string, length int, ids string, lane int").repartition(3)
    got = bp.pack(df, capacity=capacity, ranks=ranks).collect()
    want = brute.pieces(texts(), encode, capacity)
    assert ordered(tuple(r)[:5] for r in got) == ordered(want)
    used, bound = whole(got, capacity), -(-sum(x[3] for x in want) // capacity)
    assert bound <= used <= bound + 2
    assert bp.pack(df.limit(0), capacity=capacity).count() == 0


def test_sequences_hold_the_ids(spark):
    encode = plain_encoder()
    df = spark.createDataFrame(texts(), "doc_id long, text string")
    found = bp.sequences(df, capacity=128).collect()
    docs = defaultdict(dict)
    for s in found:
        ids = np.frombuffer(s["ids"], "<u4")
        assert len(ids) == s["n_tokens"] <= 128
        for p in s["parts"]:
            docs[p["doc_id"]].setdefault(p["piece"], []).append(ids[p["offset"] : p["offset"] + p["length"]].tolist())
    for doc, text in texts():
        if doc not in (None, 203):
            assert sum((docs[doc][k][0] for k in sorted(docs[doc])), []) == [*encode(text or ""), 0]


def n_of(table, counts, i):
    """How many pieces row i of a plan takes."""
    length, first = table[i, :2].tolist()
    more = table[i + 1 :][table[i + 1 :, 0] == length]
    return (int(more[0, 1]) if len(more) else int(counts[length])) - first


@pytest.mark.parametrize("seed", range(6))
def test_plans(seed):
    r = np.random.default_rng(seed)
    capacity = 200
    lengths = [r.integers(1, 201, 400), r.integers(60, 70, 300), r.integers(1, 9, 2000), r.integers(90, 130, 200), np.full(77, 67), np.r_[r.integers(101, 200, 150), r.integers(1, 99, 300)]][seed]
    counts = np.bincount(lengths, minlength=capacity + 1)
    best = None
    for how in ({"even": True}, {}, {"complements": False}):
        plan, seen = bp.patterns(counts, capacity, **how), Counter()
        for times, used in plan:
            assert sum(length * copies for length, copies in used) <= capacity
            seen.update({length: times * copies for length, copies in used})
        assert all(seen[k] == counts[k] for k in range(1, capacity + 1))
        n = sum(times for times, _ in plan)
        best = n if best is None else min(best, n)
    table = bp.places(counts, capacity)
    assert best == 1 + max(int(s + (a_n - 1) // k) for s, k, a_n in ((r[3], r[2], n_of(table, counts, i)) for i, r in enumerate(table.tolist())))
    assert len({(int(a), int(b)) for a, b in table[:, :2]}) == len(table)
    gaps = []
    for x in sorted(lengths.tolist(), reverse=True):  # plain best fit
        fits = [g for g in gaps if g >= x]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - x)
    assert -(-int(lengths.sum()) // capacity) <= best <= len(gaps)


def test_both_libraries_agree():
    """The ranks give the tokenizer file's ids: all code points up to U+3000, and every 97th beyond, between letters, digits, marks and spaces."""
    encode = plain_encoder()
    fast = bp.Encoder(bp.TOKENIZER, bp.RANKS)
    points = [c for c in [*range(1, 0x3000), *range(0x3000, 0x110000, 97)] if not 0xD800 <= c <= 0xDFFF]
    for k in range(0, len(points), 500):
        text = "".join(f"a{chr(c)}b 1{chr(c)}2 {chr(c)} .{chr(c)}!\n{chr(c)}" for c in points[k : k + 500])
        assert np.frombuffer(fast(text), "<u4").tolist() == encode(text)
    assert np.frombuffer(fast("a <|endoftext|>b"), "<u4").tolist() == encode("a <|endoftext|>b")


@here
def test_packing_of_the_table(spark):
    encode = plain_encoder()
    rows = [tuple(r) for r in spark.read.parquet(f"{oracle.SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op13_best_fit_packing"](spark, str(oracle.SF)).collect()
    want = brute.pieces(rows, encode)
    assert ordered(tuple(r)[:5] for r in got) == ordered(want)
    assert whole(got, 2048) <= -(-sum(x[3] for x in want) // 2048) + 1
    assert all(r["ids_crc32"] == zlib.crc32(b"\0\0\0\0") for r in got if r["length"] == 1)
