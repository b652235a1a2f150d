from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables here")
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["diff_id", "changed", "files", "status", "recommendation", "reason"] and df.count() > 0
