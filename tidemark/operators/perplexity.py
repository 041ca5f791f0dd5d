"""Perplexity from token losses.

A loss table has one row per scored token with ``nll`` and the columns that group it: run, split,
batch, word class. Perplexity is exp of the mean over batches of each batch's mean loss; the mean over all
tokens is offered as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import IGNORED_LABEL
from tidemark.functions.predicates import WORD_CLASSES
from tidemark.operators.ordinals import running_sums


def scored_only(losses: DataFrame, label: str = "label") -> DataFrame:
    """Tokens whose label takes part in the loss."""
    return losses.filter(F.col(label) != IGNORED_LABEL)


def batch_losses(losses: DataFrame, by: list[str] = (), batch: str = "batch_id") -> DataFrame:
    """Mean loss of every batch."""
    return losses.groupBy(*by, batch).agg(F.avg("nll").alias("loss"), F.count("nll").alias("tokens"))


def perplexity(losses: DataFrame, by: list[str] = (), batch: str = "batch_id", weighting: str = "batch") -> DataFrame:
    """Perplexity per ``by``; ``weighting`` is ``batch`` or ``token``."""
    if weighting == "token":
        return losses.groupBy(*by).agg(F.exp(F.avg("nll")).alias("ppl"))
    means = batch_losses(losses, by, batch)
    return means.groupBy(*by).agg(F.exp(F.avg("loss")).alias("ppl"))


def class_perplexity(
    losses: DataFrame, classes: list[str] = WORD_CLASSES, by: list[str] = (), batch: str = "batch_id", empty: str = "skip"
) -> DataFrame:
    """One row per ``by`` with the perplexity of all tokens and of each word class.

    One pass: each batch becomes one row of conditional means. A batch without a token of a class is
    left out of that class, or makes it NaN with ``empty='propagate'``.
    """
    def mean(value: Column) -> Column:
        m = F.avg(value)
        return F.coalesce(m, F.lit(float("nan"))) if empty == "propagate" else m

    per_batch = losses.groupBy(*by, batch).agg(
        mean(F.col("nll")).alias("all"),
        *[mean(F.when(F.col("word_class") == c, F.col("nll"))).alias(c) for c in classes],
    )
    return per_batch.groupBy(*by).agg(*[F.exp(F.avg(c)).alias(c) for c in ["all", *classes]])


def running_perplexity(
    batches: DataFrame, by: list[str], step: str = "batch_id", width: int = 100_000
) -> DataFrame:
    """Perplexity after every batch, over all batches so far within ``by``.

    Add the pass number to ``by`` to start anew with each validation pass.
    """
    sums = {"_loss": F.col("loss"), "_count": F.lit(1)}
    running = running_sums(batches, by, step, sums, width)
    return running.withColumn("running_ppl", F.exp(F.col("_loss") / F.col("_count"))).drop("_loss", "_count")
