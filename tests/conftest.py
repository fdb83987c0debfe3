from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from scrubline.frames import ROW_ID
from scrubline.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "6g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """table("a int, b string", [(1, "x"), ...]) with row order attached."""

    def build(schema, rows, row_id=True):
        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        if not row_id:
            return spark.createDataFrame(rows, schema)
        return spark.createDataFrame(
            [(*r, i) for i, r in enumerate(rows)], f"{schema}, {ROW_ID} bigint"
        )

    return build


@pytest.fixture
def values():
    """The values of a column in row order."""

    def read(df, column):
        return [r[0] for r in df.orderBy(ROW_ID).select(f"`{column}`").collect()]

    return read
