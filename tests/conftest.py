import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session(4)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
