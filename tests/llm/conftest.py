"""Rows every operator of the package must cope with."""

import pytest

AWKWARD = ["", None, " ", "\n\n", "one", "ÀÉ ß", "a\x0bb\x0cc", "the same words again and again " * 3, "x" * 5000, "word " * 3000]


@pytest.fixture()
def awkward(spark):
    """Nulls in every column, repeated rows, empty and very long texts, an extra column with a dotted name."""
    rows = [(i, t, "en", "src0", len(t or ""), "extra") for i, t in enumerate(AWKWARD)]
    rows += [(None, "no id", None, None, None, None), (None, None, None, None, None, None), rows[7], rows[7]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `n.words` string")


@pytest.fixture()
def no_rows(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
