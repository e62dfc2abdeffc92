"""Driver contract: entry() and the query registry."""

from __future__ import annotations

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["case_id", "n_rows", "n_alert_threshold", "n_alert_change", "n_label"]


def test_oracle_keys_subset_of_queries():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60
