import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tagloom.session import configure

    session = (
        SparkSession.builder.master("local[8]")
        .appName("tagloom-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def events(spark):
    return spark.read.parquet(f"{DATA}/events.parquet")


def rows(df, *keys):
    """Collected rows as tuples, sorted, floats rounded."""
    def norm(v):
        return round(v, 8) if isinstance(v, float) else v

    out = [tuple(norm(v) for v in r) for r in df.select(*(keys or df.columns)).collect()]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v) for v in r))
