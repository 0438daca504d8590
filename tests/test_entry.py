import os

import pytest

import __spark_entry__ as engine

SMALL = "/root/testdata/sf0.001"


def test_registry():
    queries, sql = engine.queries(), engine.oracle_sql()
    assert set(sql) <= set(queries)
    assert {"evaluate_summary", "leakage_safe_split", "vocab_master"} <= set(queries)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
def test_flagship(spark):
    assert {r["metric"] for r in engine.entry(spark).collect()} == {"n", "BLEU-4", "ROUGE-L", "ExactMatch%", "InVocab%"}
