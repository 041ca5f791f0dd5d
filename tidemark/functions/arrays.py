"""Expressions on token arrays. Every function maps Columns to a Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORED_LABEL = -100  # fixed value: label that takes no part in a loss


def mask_padding(ids: Column, pad_id: int) -> Column:
    """Padding becomes the ignored label."""
    return F.transform(ids, lambda x: F.when(x == pad_id, F.lit(IGNORED_LABEL)).otherwise(x))


def strip_prompt(ids: Column, prompt_length: int) -> Column:
    """Tokens behind the prompt; a shorter array gives an empty one."""
    return F.slice(ids, F.lit(prompt_length + 1), F.greatest(F.size(ids) - prompt_length, F.lit(0)))


def next_labels(labels: Column) -> Column:
    """Label that position t is scored against: label t + 1."""
    return F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0)))


def shift_right(ids: Column, start_id: int, pad_id: int) -> Column:
    """Decoder input: start token first, last token dropped, ignored labels padded."""
    kept = F.slice(ids, F.lit(1), F.greatest(F.size(ids) - 1, F.lit(0)))
    shifted = F.when(F.size(ids) == 0, kept).otherwise(F.concat(F.array(F.lit(start_id)), kept))
    return F.transform(shifted, lambda x: F.when(x == IGNORED_LABEL, F.lit(pad_id)).otherwise(x))


def fit_length(ids: Column, length: int, pad_id: int, pad_side: str = "left") -> Column:
    """Cut to ``length`` and pad up to it."""
    cut = F.slice(ids, 1, length)
    padding = F.array_repeat(F.lit(pad_id), F.lit(length) - F.size(cut))
    return F.concat(padding, cut) if pad_side == "left" else F.concat(cut, padding)


def attention_mask(ids: Column, length: int, pad_side: str = "left") -> Column:
    """1 on real tokens, 0 on padding, for the array before padding."""
    real = F.least(F.size(ids), F.lit(length))
    ones, zeros = F.array_repeat(F.lit(1), real), F.array_repeat(F.lit(0), F.lit(length) - real)
    return F.concat(zeros, ones) if pad_side == "left" else F.concat(ones, zeros)


def rolling_windows(ids: Column, prefix, max_length: int, context: int) -> Column:
    """Array of ``(input, predicted)``; every token is predicted exactly once.

    The first window predicts its whole length behind a prefix token. Each later one predicts up to
    ``max_length - context + 1`` new tokens and carries the tokens in front of them as input.
    """
    if not 1 <= context <= max_length:
        raise ValueError("context must lie between 1 and max_length")
    step = max_length - context + 1
    n = F.size(ids)
    first = F.least(n, F.lit(max_length))
    opening = F.array(
        F.struct(
            F.concat(F.array(F.lit(prefix)), F.slice(ids, F.lit(1), F.greatest(first - 1, F.lit(0)))).alias("input"),
            F.slice(ids, F.lit(1), first).alias("predicted"),
        )
    )

    def later(done):
        end = F.least(done + step, n)
        return F.struct(
            F.slice(ids, F.greatest(end - max_length, F.lit(1)), F.lit(max_length)).alias("input"),
            F.slice(ids, done + 1, F.greatest(end - done, F.lit(0))).alias("predicted"),
        )

    following = F.transform(F.sequence(F.lit(max_length), F.greatest(n - 1, F.lit(max_length)), F.lit(step)), later)
    return (
        F.when(n == 0, F.slice(opening, 1, 0))
        .when(n <= max_length, opening)
        .otherwise(F.concat(opening, following))
    )


def disjoint_input(window: Column) -> Column:
    """Input of a window without the part its prediction repeats.

    A window that predicts one token keeps no input at all, as in the scores this must match.
    """
    a, b = window["input"], window["predicted"]
    keep = F.when(F.size(b) == 1, F.lit(0)).otherwise(F.greatest(F.size(a) - F.size(b) + 1, F.lit(0)))
    return F.slice(a, F.lit(1), keep)


def chunked(values: Column, size: int) -> Column:
    """Array of arrays of ``size`` items; the short tail stays."""
    n = F.size(values)
    parts = F.transform(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size)),
        lambda start: F.slice(values, start + 1, F.lit(size)),
    )
    return F.when(n == 0, F.slice(parts, 1, 0)).otherwise(parts)


def joined(*arrays: Column) -> Column:
    """All items of several arrays in order."""
    return F.flatten(F.array(*arrays))


def multiset_overlap(left: Column, right: Column) -> Column:
    """Number of items two arrays share, counted with repeats. Work grows with the product of the sizes."""
    return F.aggregate(
        F.array_intersect(left, right),
        F.lit(0),
        lambda total, item: total
        + F.least(F.size(F.filter(left, lambda x: x == item)), F.size(F.filter(right, lambda x: x == item))),
    )


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sorted_overlap(left: Column, right: Column) -> Column:
    """:func:`multiset_overlap` of words without blanks, by sorting both sides together. Work grows with the sizes and their logarithm."""
    side = lambda words, mark: F.transform(words, lambda w: F.concat(w, F.lit(mark)))

    def shared(s: Column, starts: Column) -> Column:
        """A word's run on the left comes right before its run on the right; bounds behind the last run are null."""
        def of_run(start, run):
            then, end = F.get(starts, run + 1), F.get(starts, run + 2)
            word = F.get(s, start)
            other = F.concat(F.substring(word, F.lit(1), F.length(word) - 1), F.lit("1")) == F.get(s, then)
            return F.when(other, F.least(then - start, end - then)).otherwise(0)

        return F.aggregate(F.transform(starts, of_run), F.lit(0), lambda total, n: total + n)

    def counted(s: Column) -> Column:
        begins = lambda i: (i == 0) | (i == F.size(s)) | (F.get(s, i) != F.get(s, i - 1))
        return _with(F.filter(F.sequence(F.lit(0), F.size(s)), begins), lambda starts: shared(s, starts))

    return _with(F.sort_array(F.concat(side(left, " 0"), side(right, " 1"))), counted)
