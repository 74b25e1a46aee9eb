import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from knowspark.session import RECOMMENDED_CONF  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("work")))
    )
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.addPyFile(os.path.join(os.path.dirname(__file__), "backends.py"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def store(spark, sf_dir):
    from knowspark.sources import tables
    return tables.load(spark, sf_dir)


@pytest.fixture(scope="session")
def make_store(spark):
    """A store of inline rows: ``make_store(thoughts=[dict(id=..., ...)])``."""
    from knowspark import schema
    from knowspark.sources.store import Store

    def make(**tables):
        frames = {}
        for name, struct in schema.TABLES.items():
            rows = [tuple(row.get(f.name) for f in struct.fields) for row in tables.get(name, [])]
            loose = type(struct)([type(f)(f.name, f.dataType, True) for f in struct.fields])
            frames[name] = spark.createDataFrame(rows, loose)
        return Store(**frames)

    return make
