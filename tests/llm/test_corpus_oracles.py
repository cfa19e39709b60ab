"""Queries that SQL can express, against their SQL on whole tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from oracle import same  # noqa: E402

from tesserae.llm.oracles import ORACLES  # noqa: E402
from tesserae.llm.queries import QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, tiny, name):
    same(spark, tiny, QUERIES[name], ORACLES[name])


def test_all_are_registered():
    import __spark_entry__ as e

    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(e.queries())
