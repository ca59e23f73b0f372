import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)


@pytest.fixture(scope="session")
def spark():
    from askloom.session import local_session

    made = local_session(8, 4, **{"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"})
    yield made
    made.stop()
