import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from cases import ODD  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def clashing(odd):
    """The odd rows with columns that bear the names of what operators add, and an odd name."""
    from pyspark.sql import functions as F

    out = odd
    for c in ("n_words", "N_HIT", "size", "score", "lang_pred", "n_tokens", "n_removed", "key", "value", "id", "a.b", "licenses", "kept_id"):
        out = out.withColumn(c, F.lit("kept"))
    return out
