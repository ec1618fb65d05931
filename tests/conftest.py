import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from inkstone.session import build

    s = build("local[4]", 4, **{"spark.driver.memory": "4g", "spark.sql.warehouse.dir": "/tmp/inkstone-warehouse"})
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
