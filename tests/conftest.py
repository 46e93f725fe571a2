import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from shelfmark import session

    s = session.build("local[4]", "tests", 4)
    s.sparkContext.setLogLevel("ERROR")
    return s
