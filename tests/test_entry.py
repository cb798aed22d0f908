import os
import sys

import pytest

import __spark_entry__ as entry

pytestmark = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "o_orderdate", "c_name", "n_name"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("missing", ["quarryflow.llm", "quarryflow.llm.queries", "regex", "corpus_pipeline"])
def test_the_other_queries_stay_without_optional_parts(monkeypatch, missing):
    for name in [n for n in sys.modules if n.startswith("quarryflow.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    found = entry.queries()
    assert "overdue_list_4way" in found and "pipeline" not in found and set(entry.oracle_sql()) <= set(found)
    assert missing == "corpus_pipeline" or not any(name.startswith("op1") for name in found)
