import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pitlane.session import session, ship_code


@pytest.fixture(scope="session")
def spark():
    s = session("4", 4)
    ship_code(s)
    return s
