from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from panelspark.session import local_session

    session = local_session(cpus=8, app="panelspark-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    from check import connect

    return connect(SF)
