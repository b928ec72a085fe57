import pytest

from arborix.llm.queries import ORACLES, QUERIES
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLES:
        assert_same(spark, connect(SF), QUERIES[name], ORACLES[name], SF)
    else:
        df = QUERIES[name](spark, SF)
        key = "page_id" if name.startswith("op1_") else "doc_id"
        assert key in df.columns
        if not name.startswith("op7"):
            assert df.count() == spark.read.parquet(f"{SF}/{'pages' if key == 'page_id' else 'documents'}.parquet").count()
