import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lingospan.config import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[*]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
            # The folder that a cluster shares: intermediate tables and checkpoints go there.
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tests-shared-"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
