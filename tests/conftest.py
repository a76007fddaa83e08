import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from claimweave.session import build_session, shared_dir


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]",
        "tests",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    shared_dir(session)
    yield session


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
