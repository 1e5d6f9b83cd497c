import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tabloom.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session(
        "tests",
        spark__master="local[8]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="8g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__log__level="ERROR",
    )


@pytest.fixture(scope="session")
def frame(spark):
    """Rows as tuples with a DDL schema; shuffled so that no test can rely on input order."""

    def build(schema, rows):
        return spark.createDataFrame(list(rows), schema).repartition(3)

    return build
