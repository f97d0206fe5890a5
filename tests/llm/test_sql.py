"""Corpus queries against their DuckDB SQL on the smallest driver tables."""

import pytest
from oracle_compare import compare

from vigil.llm.queries import ORACLES, QUERIES
from vigil.plans import registry


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, monkeypatch, name):
    monkeypatch.setattr(registry, "QUERIES", QUERIES)
    monkeypatch.setattr(registry, "ORACLES", ORACLES)
    (status, detail), = compare(spark, "/root/testdata/sf0.001", [name], verbose=False).values()
    assert status in ("OK", "OK~"), f"{name}: {status} {detail}"
