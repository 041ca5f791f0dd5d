"""Places where users bring their own model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

LOSSES = "example_id long, pos int, token_id long, nll double"
PREDICTIONS = "example_id long, prediction string"


def score_with(
    rows: DataFrame, scorer: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str = LOSSES
) -> DataFrame:
    """Run a user's model over Arrow batches of rows.

    ``scorer`` gets an iterator, so it loads its model once per task and not once per batch. Its output is a
    loss or a prediction table and goes on like any other.
    """
    return rows.mapInPandas(scorer, schema)
