import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tessera.session import session

    options = {"spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    s = session("local[4]", 4, **options)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
