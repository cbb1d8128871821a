from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, sequence_id string, component_id string"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(1)
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 9))) for _ in range(600)]


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text) as a table with further columns, some of which clash with the operators' own."""
    return lambda rows: spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t), "x", "y", "z") for d, t in rows], DOCS)
