"""Text expressions on hand-written rows and generated ones."""

import re
import string

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import text as T

EDGE = [
    "", "a", "éa a b", "l’a mont", "a–the x", "The  <extra_id_0> cat.", "a\x1cb", "An apple, a day: THE end!", " wide blank ",
    "The the a an", "under_score a_b", "…", "x\ty\r\nz",
]
PUNCTUATION = re.compile("[" + re.escape(string.punctuation) + "]")


def plain_normal(text: str) -> str:
    """Words of the lowered text without ASCII punctuation; an article is a word of its own between word boundaries."""
    bare = PUNCTUATION.sub("", text.lower())
    return " ".join(w for w in re.split(r"\s+", re.sub(r"(?<!\w)(?:the|an|a)(?!\w)", " ", bare)) if w)


def apply(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["v"] for r in df.select("i", expression(F.col("t")).alias("v")).orderBy("i").collect()]


def test_normalize_answer_edge_rows(spark):
    assert apply(spark, EDGE, T.normalize_answer) == [plain_normal(v) for v in EDGE]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="aAnthe .,'\"!-_<>é\t\n0", max_size=25), min_size=20, max_size=60))
def test_normalize_answer_generated(spark, values):
    assert apply(spark, values, T.normalize_answer) == [plain_normal(v) for v in values]


def test_answer_tokens_of_nothing(spark):
    assert apply(spark, ["", " The ", "a cat"], T.answer_tokens) == [[], [], ["cat"]]


def test_drop_marks(spark):
    assert apply(spark, ["<pad>It's</s> \"one\", two.<pad>"], T.drop_marks) == ["Its one two"]


def test_first_sentence(spark):
    assert apply(spark, ["One. Two.", "none", ".x", ""], T.first_sentence) == ["One.", "none", ".", ""]


def test_strip_blanks(spark):
    assert apply(spark, [" \n x y\t ", "\x1cx ", ""], T.strip_blanks) == ["x y", "x", ""]


def test_detokenize(spark):
    given_text = "do n't ( see ) it , he said . \" no \" 's"
    assert apply(spark, [given_text], T.detokenize) == ["don't (see) it, he said.\"no\"'s"]


@pytest.mark.parametrize("args, parsed", [("a=1,b=2", {"a": "1", "b": "2"}), (" ", {}), ("a=1,a=2", {"a": "2"}), ("a=", {"a": ""})])
def test_parse_arguments(one, args, parsed):
    assert one(T.parse_arguments(F.col("t")), t=args) == parsed
    assert one(T.arguments_are_valid(F.col("t")), t=args)


@pytest.mark.parametrize("args", ["a", "a=1=2", "a=1,,b=2"])
def test_bad_arguments(one, args):
    assert not one(T.arguments_are_valid(F.col("t")), t=args)


def test_tokens_and_sentences(one):
    assert one(T.tokens(F.col("t")), t="It's 3.5, né!") == ["It", "'", "s", "3", ".", "5", ",", "né", "!"]
    assert one(T.sentences(F.col("t")), t="One. Two!? three\n\n. Four") == ["One.", "Two!?", "three", "Four"]


def test_word_pieces_cost_of_blanks(one):
    pieces = one(T.word_pieces(F.col("t")), t="  it's   so ")
    assert [(p["word_pos"], p["token"], p["first"], p["span"]) for p in pieces] == [
        (0, "it", True, 3), (0, "'", False, 3), (0, "s", False, 3), (0, " ", False, 0), (0, " ", False, 0), (1, "so", True, 1), (1, " ", False, 0),
    ]
    assert [p["token"] for p in one(T.word_pieces(F.col("t")), t="a b")] == ["a", "b"]
    assert one(T.word_pieces(F.col("t")), t="  ") == []
    assert one(T.word_pieces(F.col("t")), t="") == []


@pytest.mark.parametrize("text", ["  it's   so ", "a b", "  ", "", "a-b\t.  \n\n   c", "\n  x", "é, 漢字!  ok", "\u2003  \u2003"])
def test_word_starts_stand_at_the_first_tokens(one, text):
    pieces = one(T.word_pieces(F.col("t")), t=text)
    starts = one(T.word_starts(F.col("t")), t=text)
    assert [w and (w["word_pos"], w["word"], w["span"]) for w in starts] == [
        (p["word_pos"], p["word"], p["span"]) if p["first"] else None for p in pieces]
