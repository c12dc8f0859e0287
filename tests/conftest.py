import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def hot(spark):
    """Treat every group of more than three rows as hot."""
    spark.conf.set("spark.sitelens.smallInputBytes", "0")
    spark.conf.set("spark.sitelens.hotGroupRows", "4")
    yield spark
    spark.conf.unset("spark.sitelens.smallInputBytes")
    spark.conf.unset("spark.sitelens.hotGroupRows")
