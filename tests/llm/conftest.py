from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) rows, with columns whose names clash with the operators' own."""

    def make(rows):
        df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
        return df.selectExpr("*", "doc_id AS id", "text AS t", "0 AS recipe", "1 AS fp", "2 AS g", "3 AS score", "4 AS pick", "5 AS h")

    return make


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = "la " * 30_000 + "wort. " * 5_000
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, long), (5, long), (5, long), (6, "x"), (None, "x"), (None, None), (7, "¿É? 中文 <|endoftext|> ǅ"), (8, "a" * 5000), (9, "!!! ... 123")]
    return rows
