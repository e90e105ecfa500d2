import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

from tests.helpers import day

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").appName("tests")
         .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def walk(spark):
    """Random-walk closes of four assets, one of them with gaps."""
    import numpy as np
    rng = np.random.default_rng(11)
    rows = []
    for a in "ABCD":
        c = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 330)))
        rows += [(a, day(i), float(x)) for i, x in enumerate(c) if a != "D" or i % 7]
    return spark.createDataFrame(rows, "asset string, date date, close double").cache()
