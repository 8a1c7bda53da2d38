import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from factloom.runtime import importable, session

    s = session(4, 4, **{"spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")), "spark.driver.memory": "4g", "spark.sql.maxMetadataStringLength": "2000"})
    importable(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture()
def table(spark, tmp_path):
    """Write rows as a Parquet table and read it back, as file-based operators need it."""

    def make(rows, schema, name="t"):
        path = str(tmp_path / name)
        spark.createDataFrame(rows, schema).coalesce(2).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    return make


def as_set(df):
    return {tuple(r) for r in df.collect()}
