"""One local session for all tests; workers import the package from the repository."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

REPO = str(Path(__file__).resolve().parent.parent)
os.environ["PYTHONPATH"] = os.pathsep.join([REPO, str(Path(REPO) / "tests"), os.environ.get("PYTHONPATH", "")])
sys.path[:0] = [REPO, str(Path(REPO) / "tests")]


@pytest.fixture(scope="session")
def spark():
    from strataform.session import local_session

    session = local_session(memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
