import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from stintlab.session import build_session
    s = build_session("local[2]", 4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def cfg():
    from stintlab.config import default_config
    return default_config()
