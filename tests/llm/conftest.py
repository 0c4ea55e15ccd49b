import os
import sys

import pytest

sys.path.insert(0, os.path.abspath(os.path.join(os.path.dirname(__file__), "..", "..")))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table of (doc_id, text) pairs, with a column whose name an operator may use itself."""

    def make(rows):
        full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
        from pyspark.sql import functions as F

        return spark.createDataFrame(full, DOCS).withColumn("score", F.lit(1)).withColumn("bucket", F.lit("x")).withColumn("component_id", F.lit(None).cast("long"))

    return make
