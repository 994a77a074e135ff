import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from parcelspark.session import build

    conf = {"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}
    session = build("local[8]", 4, **conf)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
