import __spark_entry__


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_runs(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 44 and {r.status for r in rows} >= {"IdentityFound", "MaxResolutionReached"}
