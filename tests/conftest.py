from __future__ import annotations

import pytest

from hashgrove.session import spark_session


@pytest.fixture(scope="session")
def spark():
    session = spark_session(
        "tests",
        spark__master="local[8]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="8g",
        spark__driver__host="127.0.0.1",
        spark__driver__bindAddress="127.0.0.1",
        # tiny inputs: compiling plans would take most of the time
        spark__sql__codegen__wholeStage="false",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
