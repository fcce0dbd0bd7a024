import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4")
               .config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def readings(spark):
    from telluria.sources.tables import readings as view

    return view(spark, SF).cache()


def table_of(df, *columns):
    """Rows as a sorted list of tuples, doubles rounded."""
    rows = [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()]
    return sorted(rows, key=repr)
