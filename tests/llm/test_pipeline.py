import pandas as pd
import pytest

import corpus_pipeline
from rosterlake.llm._common import settled
from tests.llm import brute


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    """A small documents and benchmark table."""
    at = tmp_path_factory.mktemp("sf")
    base = [" ".join(f"w{k}x{i}" for i in range(70)) for k in range(30)]
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(base)]
    more = [base[0], base[1].replace("w1x5 ", "other "), base[2][:60], base[3] + " that item is here in ten words or a few more", base[4] + " mail a.b@c.example.com", None]
    rows += [(100 + k, t, None, None if k == 5 else "s0", len(t or "")) for k, t in enumerate(more)]
    pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).to_parquet(at / "documents.parquet")
    pd.DataFrame([(1, "that item is here in ten words or a few")], columns=["item_id", "text"]).to_parquet(at / "benchmark.parquet")
    return str(at)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs = settled(stage(spark, docs, sf))
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()} if "text" in docs.columns else {r["doc_id"] for r in docs.collect()}
        if name != "mixture":
            assert docs.columns == columns
        if name == "near_duplicates":
            assert set(seen[name]) == {c for _, _, c, _ in brute.joined(before, 5, 80)}
        if name == "benchmark_passages":
            assert set(seen[name]) == {r[0] for r in brute.contaminated(before, [(1, "that item is here in ten words or a few")], 10) if not r[5]}
    assert not {102, 105} & set(seen["quality_rules"]) and set(range(30)) <= set(seen["quality_rules"])
    assert not {100, 101} & set(seen["near_duplicates"])
    assert 103 in seen["near_duplicates"] or 3 in seen["near_duplicates"]
    assert all("a.b@c.example.com" not in t for t in seen["personal_data"].values())
    assert seen["mixture"] <= set(seen["personal_data"])


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "source", "n_tokens", "epoch", "block", "weight"] and got.count() > 20
