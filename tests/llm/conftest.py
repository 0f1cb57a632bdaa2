"""Fixtures of the training-data tests."""

import pytest


@pytest.fixture(scope="session")
def table(spark):
    """Documents with nulls, empty, long and repeated rows and extra columns."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    rows = [(5, "One line here\nshared line of words\nlast own line", "src0"), (6, "Other start\nshared line of words\nend of it", "src1"),
            (7, "One line here\nshared line of words\nlast own line", "src0"), (7, "One line here\nshared line of words\nlast own line", "src0"),
            (8, "", "src1"), (9, None, None), (None, "text without an id, mail ann@example.org or +1 (415) 555-2671", "src2"),
            (10, long, "src0"), (11, long + " tail", "src0"), (12, " \t\n ", "src2"), (13, "▁x  ▁▁y <|endoftext|> É ﬁ 汉字", "src2")]
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows],
                                 "doc_id long, text string, source string, doc int, text_hash int, _doc int, shard int")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
