import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark():
    from parley.session import session

    s = session("local[4]", spark_sql_shuffle_partitions="4", spark_ui_enabled="false", spark_driver_memory="3g", spark_ui_showConsoleProgress="false")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.conf.set("spark.parley.reuse", "true")  # the tables of the tests do not change
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
