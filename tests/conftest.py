import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from contractflow.session import build_session  # noqa: E402
from contractflow.sources.files import Storage  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[8]", "contractflow-tests",
        spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def storage(tmp_path):
    return Storage(str(tmp_path / "store"))


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()
