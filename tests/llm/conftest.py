import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, blob string, spans int"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of the given (doc_id, text), with extra columns whose names the operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), "x", 1) for i, t in rows], SCHEMA)

    return make
