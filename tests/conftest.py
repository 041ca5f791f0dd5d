from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from tidemark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g", spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def one(spark):
    """Value of an expression on a one-row table of the given columns."""

    def value(expression, **columns):
        schema = ", ".join(f"{n} {'array<int>' if isinstance(v, list) else 'string'}" for n, v in columns.items())
        return spark.createDataFrame([tuple(columns.values())], schema).select(expression.alias("v")).first()["v"]

    return value


def rows(df, *names):
    names = names or df.columns
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
