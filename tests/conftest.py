import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from siftwell.session import build_session  # noqa: E402

# built before collection: columns of the test modules need a live session
SESSION = build_session("local[8]", 8, **{"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()
