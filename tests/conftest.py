import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from vietloom.session import get_session

    s = get_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__sql__warehouse__dir="/tmp/vietloom-warehouse")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def frame(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)
