"""Every query against its SQL, on whole tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from oracle import same  # noqa: E402

from tesserae.queries import ORACLES, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, tiny, name):
    same(spark, tiny, QUERIES[name], ORACLES[name])


def test_rows_only(spark, tiny):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, tiny).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 60
    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())
