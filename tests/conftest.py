import logging
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from peerspark.session import build_session
    s = build_session("tests", "8", shuffle_partitions=4)
    logging.getLogger("DataFrameQueryContextLogger").setLevel(logging.CRITICAL)
    yield s
    s.stop()
