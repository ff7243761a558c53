"""Small documents with the cases that every operator must bear."""

from __future__ import annotations

import pytest
from hard_texts import hard_texts

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    """Rows with extra columns; one row is there twice, one id is null, one id has two texts."""
    out = [(i * 7 % 101, t, "en", f"s{i % 4}" if i % 9 else None, None) for i, t in enumerate(hard_texts())]
    return [*out, out[6], (None, "text without an id", None, "s1", 3), (out[20][0], "another text", "de", "s2", 0)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)
