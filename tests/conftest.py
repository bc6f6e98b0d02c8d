import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from hoptrail.session import build_session

    return build_session("local[4]", "tests", spark_sql_shuffle_partitions="4", spark_ui_enabled="false", spark_driver_memory="6g")
