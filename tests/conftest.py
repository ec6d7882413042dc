import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from spanrules.session import get_session

    scratch = tempfile.mkdtemp(prefix="spanrules-test-")
    s = get_session("local[*]", app="spanrules-tests", conf={
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.local.dir": scratch,
        "spark.checkpoint.dir": os.path.join(scratch, "checkpoints"),
    })
    yield s
    s.stop()
