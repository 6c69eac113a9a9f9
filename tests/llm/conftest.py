import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """A frame of documents from (doc_id, text) pairs, with a clashing extra column."""
    def make(rows):
        rows = [(i, t, "en", "s", len(t or ""), "x") for i, t in rows]
        return spark.createDataFrame(rows, DOC + ", digest string")

    return make
