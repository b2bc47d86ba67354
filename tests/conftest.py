import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quillmill.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("quillmill-tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a document table from texts; ids are positions."""
    def make(*texts):
        return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    return make


@pytest.fixture(scope="session")
def texts_of():
    """Collects one text column by document id."""
    def run(df, column="text_out"):
        return [r[column] for r in df.orderBy("doc_id").select(column).collect()]

    return run


@pytest.fixture(scope="session")
def one(spark):
    """Evaluates a column function on single texts."""
    from pyspark.sql import functions as F

    def run(fn, *values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, t string")
        return [r[1] for r in df.select("i", fn(F.col("t")).alias("o")).orderBy("i").collect()]

    return run
