from __future__ import annotations

import __spark_entry__ as entry


def test_names_agree_and_the_flagship_runs(spark):
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names
    assert len(names) > 200
    assert entry.entry(spark).count() > 0
