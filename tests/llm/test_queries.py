"""The queries that SQL can express against their SQL, and the rows of the others."""

import pytest

from tests.sqlcheck import FOLDER, same_rows
from textclusters.llm import registry

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no data folder")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    same_rows(spark, registry.QUERIES[name], registry.ORACLES[name])


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in registry.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", ["op2_pii", "op4_simhash", "op5_substrings", "op7_quality", "op9_bpe", "op10_lmscore", "op12_periods", "op13_minhash"])
def test_query_has_a_row_for_each_document(spark, name):
    ids = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id")
    found = registry.QUERIES[name](spark, str(FOLDER)).select("doc_id")
    assert sorted(r.doc_id for r in found.collect()) == sorted(r.doc_id for r in ids.collect())
