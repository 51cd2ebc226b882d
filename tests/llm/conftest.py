import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def documents(spark):
    """sf0.001's documents, as [(doc_id, text)]."""
    return [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]


AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, block long, shard long, part string, size int, node long"


@pytest.fixture(scope="session")
def awkward_rows():
    """Nulls in each column, empty and very long texts, ties, repeated rows."""
    passage = " ".join(f"word{i}" for i in range(60))
    long = " ".join(f"w{i % 7919}x{i}" for i in range(60_000))
    rows = [
        (1, "the quick brown fox"), (1, "the quick brown fox"), (2, None), (3, ""), (None, "the quick brown fox"), (None, None), (4, passage), (5, passage + " tail"),
        (6, "head " + passage), (7, " \t\n "), (8, "İstanbul ΣΑΣ 日本語 😀 <|endoftext|> don't"), (9, long), (10, "a" * 3000), (11, "ab" * 500), (4, passage), (12, "\x1c odd\x85space\xa0here"), (2**62, "you idiot"),
    ]
    return [(d, t, None, "src0" if (d or 0) % 2 else None, None, 1, 2, "x", 3, 4) for d, t in rows]


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return spark.createDataFrame(awkward_rows, AWKWARD)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], AWKWARD)
