"""Every registered query has its SQL counterpart."""

from __future__ import annotations

import __spark_entry__ as entry
from checks.oracle_queries import ORACLES
from checks.spark_queries import QUERIES


def test_same_names():
    # The optional queries need not all have SQL; the library's own do.
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
