from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from opsignal.session import local_session

    session = local_session(4, memory="4g", partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def inputs(spark, sf_dir):
    from opsignal.catalog import Inputs

    return Inputs(spark, sf_dir)
