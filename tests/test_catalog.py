import pytest

from rosterlake.plans import catalog
from tests import oracle

pytestmark = pytest.mark.skipif(not oracle.SF.exists(), reason="the driver's tables aren't there")


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, str(oracle.SF))
    if name in catalog.ORACLE_SQL:
        oracle.same(df, catalog.ORACLE_SQL[name])
    else:
        assert len(df.take(3)) == 3


def test_pii_rule_reads_whole_texts(spark, tmp_path):
    """What is personal after a long prefix counts."""
    talk = "so we went on " * 30
    rows = [(1, 1, "user", talk + "AB123456 it said"), (1, 2, "user", talk + "call 06 12 34 56 78 please"), (1, 3, "user", talk), (1, 4, "user", "AB123456"), (1, 5, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["turn"]: r["personal"] for r in catalog.QUERIES["pii_rule"](spark, str(tmp_path)).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: False}
