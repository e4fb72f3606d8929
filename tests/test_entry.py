"""Driver contract smoke checks."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert set(df.columns) == {"contig", "n_overlaps", "n_variants"}


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
