"""The operators are registered where their folder exists: a broken import must not pass for a missing folder."""

import __spark_entry__


def test_operators_are_registered():
    assert __spark_entry__.registry is not None
    names = set(__spark_entry__.queries())
    assert {"pipeline", "op1_pii", "op10_bpe_codec"} <= names
    assert set(__spark_entry__.oracle_sql()) <= names
