import os

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "3")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(params=["plain", "split"])
def sizes(request, spark):
    """Once with limits that nothing reaches, once with limits that make everything hot."""
    if request.param == "split":
        spark.conf.set("spark.kithwatch.hotRows", "3")
        spark.conf.set("spark.kithwatch.windowRows", "3")
    yield request.param
    spark.conf.unset("spark.kithwatch.hotRows")
    spark.conf.unset("spark.kithwatch.windowRows")


@pytest.fixture(scope="session")
def golden_folder():
    """Folder with the product co-purchase GraphML files, where the machine has them."""
    folder = os.environ.get("KITHWATCH_GOLDEN_DIR")
    if not folder:
        pytest.skip("KITHWATCH_GOLDEN_DIR is not set")
    return folder


def rows(table, *columns):
    return sorted(tuple(row) for row in (table.select(*columns) if columns else table).collect())
