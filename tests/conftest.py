import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidewater.session import local_session, ship

    own = tmp_path_factory.mktemp("spark")
    session = local_session("tests", "4", **{"spark.checkpoint.dir": f"file://{own}/shared", "spark.sql.warehouse.dir": f"file://{own}/warehouse",
                                             "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    ship(session)
    yield session
    session.stop()
