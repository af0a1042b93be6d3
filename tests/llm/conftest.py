import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

#: Name of a column that operators use inside, to clash with.
CLASHES = ["score", "block", "bucket", "data", "component_id", "n_words", "host", "digest", "_leak"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls anywhere, empty and long texts, ties, repeated rows, clashing columns."""
    long = " ".join(f"word{i % 977} line{i}" for i in range(30_000))
    base = " ".join(f"base{i}" for i in range(120))
    rows = [
        (1, base), (1, base), (2, base), (3, base + " and a little more"), (4, None), (5, ""), (6, " \n\t "), (7, long), (8, long + " end"),
        (9, "short"), (10, "short"), (None, base), (None, None), (11, "Ünïcödé " * 30), (12, "x" * 3000), (13, "x" * 3000),
        (2, "another text with the same id as before, quite different from it"), (14, "<|endoftext|> mid<|startoftext|>dle ##"), (15, "a\x00b\x1c\x85c"),
    ]
    full = [(i, t, None if k % 3 else "src0", None, *(["clash"] * len(CLASHES))) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, source string, lang string, " + ", ".join(f"{c} string" for c in CLASHES))


@pytest.fixture(scope="session")
def sample(spark):
    """A few hundred whole documents of the test data, copies among them."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
