import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from texts import TEXTS  # noqa: E402


@pytest.fixture(scope="session")
def awkward(spark):
    """Rows with nulls in any column, ties, repeated rows, long texts and names that may clash."""
    rows = [(i, t, None if i % 2 else "en", f"s{i}", i) for i, t in enumerate(TEXTS)]
    rows += [rows[0], (None, None, None, None, None), (None, TEXTS[0], "en", None, 1), (3, "other text", "fr", "s", 2)]
    schema = ("doc_id long, text string, lang string, id string, row long")
    more = spark.createDataFrame(rows, schema)
    return more.selectExpr("*", "1 AS n_words", "'k' AS keys", "2 AS node", "3 AS rank", "4 AS word_chars")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")
