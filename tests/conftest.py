import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from feldspark.session import local_session

    # Without coalescing, small tables spread over several partitions, as large ones do.
    session = local_session(
        app="feldspark-tests",
        spark__sql__adaptive__coalescePartitions__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def oracle():
    from harness import oracle_connection

    return oracle_connection(SMALL)
