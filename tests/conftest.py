import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # for the workers


@pytest.fixture(scope="session")
def spark():
    from citeloom.session import get_spark

    s = get_spark(4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
