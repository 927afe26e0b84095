"""Every registered query equals its DuckDB oracle (the driver's gate), with
the default block size and with small blocks, so that many keys are heavy."""

import pytest

from conftest import SF0001, SF001
from ruleweave.plans import queries as Q
from ruleweave.plans.check import compare
from ruleweave.plans.oracle import oracle_sql


def test_every_query_has_an_oracle():
    assert set(Q.QUERIES) == set(oracle_sql())


@pytest.mark.parametrize("sf_dir", [SF0001, SF001])
def test_queries_match_oracle(spark, sf_dir):
    res = compare(spark, sf_dir, verbose=False)
    bad = {n: r for n, r in res.items() if not (r["hash_match"] and r["cols_match"])}
    assert not bad, bad


def test_heavy_keys_match_oracle(spark, monkeypatch):
    """Every query again with keys of more than 4 rows cut into blocks."""
    monkeypatch.setattr(Q, "BLOCK_SIZE", 4)
    res = compare(spark, SF0001, verbose=False)
    assert set(res) == set(Q.QUERIES)
    bad = {n: r for n, r in res.items() if not (r["hash_match"] and r["cols_match"])}
    assert not bad, bad
