import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from cuetide.session import build_session, prepare

    return prepare(build_session(cpus="4", shuffle_partitions=4, memory="4g"))
