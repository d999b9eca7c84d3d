from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text), with the other columns filled in or null."""

    def build(rows, schema=DOCS):
        full = [(i, t, "en" if t else None, "s", len(t) if t is not None else None) for i, t in rows]
        return spark.createDataFrame(full, schema)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows and control characters."""
    long = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
    return [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, "word"),
        (5, "a b  c\n\nd\x0be \x1c f　g 'tis <|endoftext|>"),
        (6, long),
        (7, long),
        (8, "same text twice here, over and over and over"),
        (8, "same text twice here, over and over and over"),
        (9, "été Ünïcödé 漢字 🙂 " * 30),
    ]


@pytest.fixture(scope="session")
def documents(spark, sf):
    """Rows, not a cached table: a cache would change the plans of every later test over the same path."""
    return spark.read.parquet(f"{sf}/documents.parquet").collect()
