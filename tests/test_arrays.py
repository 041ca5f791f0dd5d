"""Array expressions against their defining properties."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import arrays as A


@pytest.fixture(scope="module")
def sequences(spark):
    return spark.createDataFrame([(n, list(range(100, 100 + n))) for n in range(14)], "n int, ids array<int>")


@pytest.mark.parametrize("max_length, context", [(m, c) for m in (1, 3, 5) for c in range(1, m + 1)])
def test_rolling_windows(sequences, max_length, context):
    found = sequences.select("n", "ids", A.rolling_windows(F.col("ids"), -1, max_length, context).alias("w")).collect()
    for n, ids, windows in found:
        behind = [-1, *ids]
        assert [t for w in windows for t in w["predicted"]] == ids, "every token exactly once, in order"
        done = 0
        for w in windows:
            done += len(w["predicted"])
            # the input ends right before the last predicted token and starts no earlier than it may
            size = len(w["input"])
            assert w["input"] == behind[done - size:done]
            assert size == (len(w["predicted"]) if done <= max_length else max_length)
            assert len(w["predicted"]) <= (max_length if done <= max_length else max_length - context + 1)
        assert bool(windows) == (n > 0)


def test_rolling_windows_bounds():
    with pytest.raises(ValueError):
        A.rolling_windows(None, 0, 3, 4)


def test_disjoint_input(spark):
    df = spark.createDataFrame(
        [(([1, 2, 3, 4], [5, 6]),), (([1, 2, 3], [4]),), (([1, 2], [2, 3, 4, 5]),)],
        "w struct<input: array<int>, predicted: array<int>>",
    )
    assert [r[0] for r in df.select(A.disjoint_input(F.col("w"))).collect()] == [[1, 2, 3], [], []]


def test_chunked(sequences):
    for n, ids, chunks in sequences.select("n", "ids", A.chunked(F.col("ids"), 4)).collect():
        assert [x for c in chunks for x in c] == ids
        assert all(len(c) == 4 for c in chunks[:-1]) and len(chunks) == -(-n // 4)


def test_fit_length_and_mask(one):
    ids = F.col("ids")
    assert one(A.fit_length(ids, 4, 3), ids=[7, 8]) == [3, 3, 7, 8]
    assert one(A.fit_length(ids, 4, 3, "right"), ids=[7, 8]) == [7, 8, 3, 3]
    assert one(A.fit_length(ids, 2, 3), ids=[7, 8, 9]) == [7, 8]
    assert one(A.attention_mask(ids, 4), ids=[7, 8]) == [0, 0, 1, 1]
    assert one(A.attention_mask(ids, 2, "right"), ids=[7, 8, 9]) == [1, 1]


def test_labels(one):
    ids = F.col("ids")
    assert one(A.mask_padding(ids, 3), ids=[3, 7, 3]) == [-100, 7, -100]
    assert one(A.next_labels(ids), ids=[1, 2, 3]) == [2, 3]
    assert one(A.next_labels(ids), ids=[]) == []
    assert one(A.shift_right(ids, 0, 3), ids=[5, -100, 6]) == [0, 5, 3]
    assert one(A.shift_right(ids, 0, 3), ids=[]) == []
    assert one(A.strip_prompt(ids, 2), ids=[1, 2, 3]) == [3]
    assert one(A.strip_prompt(ids, 2), ids=[1]) == []


def test_pad_side_decides_the_scored_tokens(one):
    """With left padding the first real token is scored too, with right padding it is not."""
    scored = lambda side: one(
        F.filter(A.next_labels(A.mask_padding(A.fit_length(F.col("ids"), 5, 3, side), 3)), lambda x: x != -100), ids=[7, 8, 9]
    )
    assert scored("left") == [7, 8, 9] and scored("right") == [8, 9]


def test_joined_and_overlap(one):
    assert one(A.joined(F.col("a"), F.col("b")), a=[1, 2], b=[3]) == [1, 2, 3]
    assert one(A.multiset_overlap(F.col("a"), F.col("b")), a=[1, 1, 2, 3], b=[1, 1, 1, 3, 4]) == 3
