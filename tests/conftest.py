import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from emberline.session import session
    s = session("local[8]", 2, "tests")
    s.conf.set("spark.sql.adaptive.enabled", "false")  # small fixtures: one job per action
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
