import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from brindle.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "local[8]", 4)
    s.sparkContext.setLogLevel("OFF")
    return s
