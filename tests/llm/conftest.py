from __future__ import annotations

import pytest


@pytest.fixture
def docs(spark):
    """Documents table of (doc_id, text) pairs, with columns of clashing names besides."""

    def make(rows, **more):
        schema = "doc_id long, text string, lang string, source string, n_chars long, component_id string, _row string, _v string, kept int"
        return spark.createDataFrame(
            [(i, t, more.get("lang", "en"), more.get("source", "s"), None if t is None else len(t), "x", "y", "z", 1) for i, t in rows], schema)

    return make
