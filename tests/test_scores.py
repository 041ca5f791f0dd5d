"""Answer scores against counting by hand."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.functions import predicates as P
from tidemark.operators import prompts, scores
from tidemark.plans.evaluate import answer_scores
from test_text import plain_normal

PAIRS = [
    (1, "The cat", "a cat."), (2, "", ""), (3, "one two two", "two two three two"), (4, "x", ""), (5, "the", "an"),
    (6, "red " * 300, "red blue " * 200), (7, " ".join(str(i % 50) for i in range(500)), " ".join(str(i % 70) for i in range(300))),
    (8, "... " * 200, "the " * 200), (9, "word " * 200, ""),
]


def expected_f1(a: str, b: str) -> float:
    p, t = Counter(plain_normal(a).split()), Counter(plain_normal(b).split())
    same = sum(min(n, t[w]) for w, n in p.items())
    return 2 * same / (sum(p.values()) + sum(t.values())) if same else 0.0


@pytest.mark.parametrize("in_row_chars", [0, 40, 10_000])
def test_token_f1(spark, in_row_chars):
    df = spark.createDataFrame(PAIRS, "id int, prediction string, target string")
    found = {r["id"]: r["f1"] for r in scores.token_f1(df, ["id"], in_row_chars=in_row_chars).collect()}
    assert found == {i: pytest.approx(expected_f1(a, b)) for i, a, b in PAIRS}


def test_score_answers_agree(spark):
    df = spark.createDataFrame(PAIRS, "id int, prediction string, target string")
    long = {r["id"]: (r["em"], round(r["f1"], 9)) for r in scores.score_answers(df, ["id"]).collect()}
    short = {r["id"]: (r["em"], round(r["f1"], 9)) for r in scores.score_short_answers(df).collect()}
    assert long == short
    assert long[2] == (1, 0.0), "two empty answers match, but share no word"
    assert long[1] == (1, 1.0)


def test_summary_of_nothing_is_null(spark):
    empty = spark.createDataFrame([], "em int, f1 double")
    assert tuple(scores.summarize(empty).first()) == (0, None, None, None)


def test_accuracy(spark):
    df = spark.createDataFrame([("x \n", " x"), ("x", "X"), ("", " ")], "prediction string, target string")
    assert [r[0] for r in df.select(scores.accuracy()).collect()] == [1, 0, 1]


def test_answer_scores_join_by_key(spark):
    probes = spark.createDataFrame([("s1", "r", "cat"), ("s2", "r", "dog"), ("s3", None, "x")], "subject string, relation string, object string")
    answers = spark.createDataFrame([("s2", "r", "A dog. Or two"), ("s1", "r", "dog")], "subject string, relation string, prediction string")
    # the object column becomes the target
    assert tuple(answer_scores(probes, answers, ["subject", "relation"]).first()) == (2, 1, 0.5, 0.5)


def test_row_range_split(spark):
    df = spark.range(0, 400).select("id", scores.row_range_split(F.col("id"), 32, 1).alias("s"))
    assert rows(df.groupBy("s").agg(F.min("id").alias("a"), F.max("id").alias("b"))) == [
        ("IL", 385, 399), ("NL", 337, 384), ("UL", 312, 336), ("UnL", 0, 311),
    ]


def test_prompts(spark):
    facts = spark.createDataFrame([("s", "r", "o"), ("s", None, "o")], "subject string, relation string, object string")
    complete, rejected = prompts.complete_facts(facts)
    assert (complete.count(), rejected.count()) == (1, 1)
    get = lambda mode, role="validation": tuple(prompts.fact_prompts(complete, mode, role).first())[3:]
    assert get("evaluate_ppl") == ("s r o", "s r o", " o", None) == get("pretrain")
    assert get("evaluate") == ("s r", "o", None, None)
    assert get("finetune") == ("s r", "o", None, "s r o")
    assert get("finetune", "train") == ("s r o", "s r o", None, "s r o")
    with pytest.raises(ValueError):
        prompts.fact_prompts(facts, "evaluate", "test")


def test_names(spark):
    df = spark.createDataFrame([("a_unchanged",), ("a_changed",), ("new_x",)], "d string")
    assert [r[0] for r in df.select(P.split_of_name(F.col("d"))).collect()] == ["unchanged", "changed", "changed"]
    models = spark.createDataFrame([("gpt2-large",), ("google/t5-small",)], "m string")
    assert [r[0] for r in models.select(P.model_family(F.col("m"))).collect()] == ["GPT2", "T5"]
    with pytest.raises(Exception, match="unsupported model: bert"):
        spark.createDataFrame([("bert",)], "m string").select(P.model_family(F.col("m"))).collect()
    tags = "NNP NNPS NN NNS VB VBZ MD CD JJ".split()
    df = spark.createDataFrame([(t,) for t in tags], "t string")
    assert [r[0] for r in df.select(P.word_class(F.col("t"))).collect()] == [
        "ner", "ner", "noun", "noun", "verb", "verb", None, "num", None,
    ]


def test_f1_in_row_and_exploded_agree_on_missing_sides_and_repeated_ids(spark):
    given = [(1, None, None), (2, "a b", None), (3, None, "a"), (4, "", ""), (5, "a b c", "a b d"), (5, "x", "y x"), (5, "x", "y x")]
    pairs = spark.createDataFrame(given, "id int, prediction string, target string")
    short = rows(scores.token_f1(pairs, ["id"], in_row_chars=400))
    assert short == rows(scores.token_f1(pairs, ["id"], in_row_chars=-1))
    assert [i for i, _ in short] == [1, 2, 3, 4, 5, 5, 5] and short[0] == (1, 0.0)


def test_long_answers_are_counted_without_a_shuffle(spark):
    df = spark.createDataFrame([*PAIRS, (10, None, "x " * 300), (11, "b a0 " * 300, "a0 0 b 1 " * 200)], "id int, prediction string, target string")
    found = scores.score_answers(df, ["id"])
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: (r["em"], r["f1"]) for r in found.collect()} == {
        i: (int(a is not None and plain_normal(a) == plain_normal(b)), pytest.approx(expected_f1(a or "", b))) for i, a, b in
        [*PAIRS, (10, None, "x " * 300), (11, "b a0 " * 300, "a0 0 b 1 " * 200)]}
