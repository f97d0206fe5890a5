"""Every registered query against its DuckDB oracle on the smallest driver
tables, once with plain per-run windows and once with every run cut into
16-row chunks (halo + cross-chunk carry path)."""

import os

import pytest

from oracle_compare import compare  # noqa: E402
from vigil.plans.registry import QUERIES

SF = os.environ.get("VIGIL_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def results(spark):
    return compare(spark, SF, verbose=False)


@pytest.fixture(scope="module")
def chunked_results(spark):
    spark.conf.set("vigil.window.chunkRows", "16")
    try:
        names = [n for n in QUERIES if not n.startswith(("stream_", "rf_", "gbt_"))]
        return compare(spark, SF, names, verbose=False)
    finally:
        spark.conf.unset("vigil.window.chunkRows")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(results, name):
    status, detail = results[name]
    assert status in ("OK", "OK~", "ROWS_ONLY"), f"{name}: {status} {detail}"


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(("stream_", "rf_", "gbt_"))))
def test_query_matches_oracle_chunked(chunked_results, name):
    status, detail = chunked_results[name]
    assert status in ("OK", "OK~", "ROWS_ONLY"), f"{name}: {status} {detail}"
