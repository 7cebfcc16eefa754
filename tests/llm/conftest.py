from __future__ import annotations

import pytest

LONG = "palabra otra cosa distinta " * 6000


@pytest.fixture(scope="session")
def edge_rows():
    """Null, empty, long, tied, repeated and null-id documents: (doc_id, text, lang, source, extra, text_hash)."""
    texts = [
        (1, "The quick brown fox jumps over the lazy dog and runs far away from here today"),
        (2, "The quick brown fox jumps over the lazy dog and runs far away from here today"),
        (2, "The quick brown fox jumps over the lazy dog and runs far away from here today"),
        (3, None), (4, ""), (5, " \n\t "), (6, LONG), (7, "x" * 50_000), (8, "1" * 30_000),
        (9, "one two"), (None, "a text without an id, and with some words in it"), (None, None),
        (3, "same id as a null text"), (10, "ünïcödé ÑANDÚ 漢字 emoji 😀 end"), (11, "a\x0bb\x0cc\r\nd"),
    ]
    return [(i, t, "en" if n % 2 else None, None if n % 3 else "s", "x", 7) for n, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    """The edge documents, with extra columns whose names clash with internal ones."""
    schema = "doc_id long, text string, lang string, source string, words string, text_hash int"
    return spark.createDataFrame(edge_rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(edges):
    return edges.limit(0)


@pytest.fixture(scope="session")
def some(spark, small):
    """The smallest documents table, and its rows on the driver."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    return docs, [(row.doc_id, row.text) for row in docs.collect()]
