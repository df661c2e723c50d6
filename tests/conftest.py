import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from sheaf.session import local_session

    session = local_session("4", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    yield session
    session.stop()
