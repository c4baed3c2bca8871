"""What the registry hands out as SQL is SQL."""

from askbase.llm.registry import ORACLES


def test_oracles_are_sql():
    assert all(isinstance(sql, str) for sql in ORACLES.values())
