"""Exact match, accuracy and token F1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.arrays import multiset_overlap, sorted_overlap

# Texts of up to this many characters are counted inside the row, where the work is quadratic.
IN_ROW_CHARS = 400

# Upper row bounds of the first three row-range splits, and all four names.
ROW_RANGE_SPLITS = [(10_000, "UnL"), (10_785, "UL"), (12_329, "NL")]
LAST_ROW_RANGE_SPLIT = "IL"


def match_predictions(predictions: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions beside their targets, by key and never by row position."""
    return predictions.join(targets, keys)


def exact_match(prediction: str = "prediction", target: str = "target") -> Column:
    """1 when both normalise to the same text; two empty texts match, a missing one matches nothing."""
    same = T.normalize_answer(F.col(prediction)) == T.normalize_answer(F.col(target))
    return F.coalesce(same.cast("int"), F.lit(0))


def accuracy(prediction: str = "prediction", target: str = "target") -> Column:
    """1 when both are the same apart from blanks at the ends; a missing one matches nothing."""
    return F.coalesce((T.strip_blanks(F.col(prediction)) == T.strip_blanks(F.col(target))).cast("int"), F.lit(0))


def f1_of(same: Column, predicted: Column, wanted: Column) -> Column:
    """F1 from the overlap and the two token counts; 0 without overlap."""
    precision, recall = same / predicted, same / wanted
    return F.when(same > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def token_f1(
    pairs: DataFrame, ids: list[str], prediction: str = "prediction", target: str = "target",
    in_row_chars: int = IN_ROW_CHARS,
) -> DataFrame:
    """``ids`` and ``f1`` of every pair; a missing side has no tokens. Pairs with equal ids stay rows of their own.

    Short pairs are counted as they stand, longer ones by their sorted words; either way inside the row, without a shuffle.
    """
    return _scored(pairs, ids, prediction, target, in_row_chars).drop("em")


def _scored(pairs: DataFrame, ids: list[str], prediction: str, target: str, in_row_chars: int) -> DataFrame:
    """``ids``, ``em`` and ``f1``; every text is normalised once. Words and normalised texts are the same when the others are."""
    none = F.array().cast("array<string>")
    # Without either side there is no length: nothing is long.
    short = F.coalesce(F.greatest(F.length(prediction), F.length(target)) <= in_row_chars, F.lit(True))
    split = pairs.select(
        *ids, short.alias("_short"), (F.col(prediction).isNotNull() & F.col(target).isNotNull()).alias("_both"),
        F.coalesce(T.answer_tokens(F.col(prediction)), none).alias("_p"), F.coalesce(T.answer_tokens(F.col(target)), none).alias("_t"),
    )
    same = F.when(F.col("_short"), multiset_overlap(F.col("_p"), F.col("_t"))).otherwise(sorted_overlap(F.col("_p"), F.col("_t")))
    counted = split.select(
        *ids, (F.col("_both") & (F.col("_p") == F.col("_t"))).cast("int").alias("em"),
        same.alias("_same"), F.size("_p").alias("_np"), F.size("_t").alias("_nt"),
    )
    return counted.select(*ids, "em", f1_of(F.col("_same"), F.col("_np"), F.col("_nt")).alias("f1"))


def score_answers(pairs: DataFrame, ids: list[str], prediction: str = "prediction", target: str = "target") -> DataFrame:
    """``ids``, ``em`` and ``f1`` of every pair."""
    return _scored(pairs, ids, prediction, target, IN_ROW_CHARS)


def score_short_answers(pairs: DataFrame, prediction: str = "prediction", target: str = "target") -> DataFrame:
    """Add ``em`` and ``f1`` in place, for answers known to be short. No join, no shuffle."""
    p, t = T.answer_tokens(F.col(prediction)), T.answer_tokens(F.col(target))
    return (
        pairs.withColumns({"_p": p, "_t": t})
        .withColumns({
            "em": F.coalesce((F.col("_p") == F.col("_t")).cast("int"), F.lit(0)),
            "f1": f1_of(multiset_overlap(F.col("_p"), F.col("_t")), F.size("_p"), F.size("_t")),
        })
        .drop("_p", "_t")
    )


def summarize(scores: DataFrame, by: list[str] = (), scale: float = 1.0) -> DataFrame:
    """Rows, exact matches, their rate and the mean F1. ``scale`` 100 gives percentages."""
    return scores.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.sum("em").alias("correct"),
        (F.avg("em") * scale).alias("em_rate"),
        (F.avg("f1") * scale).alias("f1"),
    )


def row_range_split(batch_id: Column, batch_size: int, devices: int) -> Column:
    """Split of a batch by fixed row bounds."""
    name = None
    for bound, split in ROW_RANGE_SPLITS:
        inside = batch_id < bound // (batch_size * devices)
        name = F.when(inside, split) if name is None else name.when(inside, split)
    return name.otherwise(LAST_ROW_RANGE_SPLIT)
