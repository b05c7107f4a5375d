"""Queries that once ran on rows of their own read a given table."""

import pytest

from siteloom.plans import registry


@pytest.mark.parametrize("name, table", [("cookies", "customer"), ("robots_file_checks", "supplier")])
def test_reads(spark, sf_dir, name, table):
    assert any(f.endswith(f"{table}.parquet") for f in registry.queries()[name](spark, sf_dir).inputFiles())
