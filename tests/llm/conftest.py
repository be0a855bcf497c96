import pytest
from pyspark.sql import functions as F

#: Names that operators use themselves, and one that must be quoted.
ODD = ["Lines", "__id", "__text", "__h1", "__k1", "__key", "__in0", "__gone", "__path", "__at", "spans", "node", "group", "a.b c"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n_words string"


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls in every column, empty and blank texts, a very long text, repeated rows, equal ids, and clashing names."""
    long_text = " ".join(f"word{i % 977} in line{i % 31}" for i in range(20_000))
    rows = [
        (None, None, None, None, None, None, None),
        (1, None, "en", "s", None, None, "x"),
        (2, "", "en", "s", 0, "a", None),
        (3, " \n\t ", None, "s", 4, "a", "b"),
        (4, "short one", "en", None, 9, "a", "b"),
        (5, long_text, "en", "s", len(long_text), "a", "b"),
        (6, long_text, "en", "s", len(long_text), "a", "b"),
        (7, "Grüße 中文 \U0001f600 ▁ x", "de", "s", 16, "a", "b"),
        (7, "Grüße 中文 \U0001f600 ▁ x", "de", "s", 16, "a", "b"),
        (7, "another text under the same id", "de", "s", 30, "a", "b"),
        (None, "a text without an id", "en", "s", 20, "a", "b"),
    ]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(f"own {c}") for c in ODD})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA).withColumns({c: F.lit(f"own {c}") for c in ODD})
