import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


ODD_TEXTS = [None, "", " ", "\n\n", "a", "One two three.", "x" * 5000, "word " * 4000, "é ñ ß Σας İ", "tie", "tie"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties and repeated rows, and extra columns with clashing names."""
    rows = [(i, t, None if i == 1 else "en", "s", 0, "x", i) for i, t in enumerate(ODD_TEXTS)]
    rows += [(9, "tie", "en", "s", 0, "x", 9), (None, "null key", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, label string, start long")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
