"""The driver contract of __spark_entry__.py."""

import __spark_entry__ as entry_mod


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["seq", "uid", "rule_id", "action", "detail"]
    assert df.count() >= 0


def test_contract_keys():
    """Every query of the reference's operators has an oracle; others may be
    registered beside them."""
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    own = {n for n in q if n.startswith("q")}
    assert len(own) == 24 and own <= set(o) <= set(q)
