from __future__ import annotations

import pytest

LONG = "lorem ipsum dolor sit amet " * 4000


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, repeated rows, ties and clashing column names."""
    words = " ".join(f"w{i}" for i in range(120))
    rows = [
        (1, words), (2, words), (2, words), (3, None), (4, ""), (5, "  \n \t"), (6, LONG), (None, words), (7, "a b"),
        (8, words + " tail"), (9, "é漢字😀 " * 40), (10, "12 34 !!"), (None, None),
    ]
    data = [(i, t, "en" if k % 2 else None, "s", 0, "x", 1, "y") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, tag string, start int, row string")


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def texts(spark):
    """Documents of the smallest tables as (doc_id, text)."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    return [(r["doc_id"], r["text"] or "") for r in rows]
