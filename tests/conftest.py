import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rimlight.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        f"local[{os.environ.get('TEST_CPUS', '4')}]",
        "tests",
        spark__sql__shuffle__partitions="4",
        spark__checkpoint__dir="file://" + str(tmp_path_factory.mktemp("shared")),
        spark__driver__memory="4g",
        spark__sql__maxMetadataStringLength="1000",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
