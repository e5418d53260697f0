import tempfile

import pytest

from platewise.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]", 4, spark__driver__memory="4g", spark__ui__showConsoleProgress="false", spark__sql__warehouse__dir=tempfile.mkdtemp(prefix="platewise-wh-"),
        spark__sql__autoBroadcastJoinThreshold="1m",
    )
    yield session


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
