import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

from revuelens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", 4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture()
def folder():
    """A new folder for each test; the system cleans /tmp."""
    return tempfile.mkdtemp(prefix="revuelens-test-")
