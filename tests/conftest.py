from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from quarry.session import build_session

    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g", spark__default__parallelism="4"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    from quarry.scratch import clear

    clear(session)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
