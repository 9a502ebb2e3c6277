import pytest

from rosterlake.llm import queries
from tests import oracle
from tests.llm import brute

pytestmark = pytest.mark.skipif(not oracle.SF.exists(), reason="the driver's tables aren't there")


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{oracle.SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    oracle.same(queries.QUERIES[name](spark, str(oracle.SF)), queries.ORACLE_SQL[name])


def test_against_brute_force(spark, docs):
    for name, want in (("op7_block_dedup", brute.blocks(docs, 35)), ("op9_suffix_dedup", brute.suffixes(docs, 400)), ("op1_ngram_join", brute.joined(docs, 4, 85))):
        got = queries.QUERIES[name](spark, str(oracle.SF)).collect()
        assert sorted(map(tuple, got)) == sorted(want), name


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{oracle.SF}/labels.parquet").collect()}
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{oracle.SF}/documents.parquet").collect()}
    right = [r["predicted"] == labels[r["doc_id"]] for r in queries.QUERIES["op2_quality_rank"](spark, str(oracle.SF)).where("held_out").collect() if r["doc_id"] in labels]
    assert sum(right) / len(right) >= 0.9
    right = [r["lang_pred"] == langs[r["doc_id"]] for r in queries.QUERIES["op3_lang_ppm"](spark, str(oracle.SF)).where("held_out").collect()]
    assert sum(right) / len(right) >= 0.95
