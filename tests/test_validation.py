"""Validation while training against scoring everything again after each step."""

import random

import pytest

from tidemark.operators import ngrams, perplexity, validation

WORDS = [f"w{i}" for i in range(40)]


def said(draw, n):
    return " ".join(draw.choice(WORDS[:draw.randint(2, 40)]) for _ in range(n))


@pytest.fixture
def checked(spark):
    draw = random.Random(5)
    rows = [(split, i, said(draw, draw.randint(1, 30))) for split in ("changed", "unchanged", None) for i in range(7)]
    rows += [("changed", 7, None), ("unchanged", 7, ""), (None, 7, "unheard of words , 1 2")]
    return spark.createDataFrame(rows, "split string, position long, text string")


@pytest.fixture
def steps(spark):
    draw = random.Random(6)
    texts = [[said(draw, 20) for _ in range(n)] for n in (1, 9, 0, 30)]  # one step without texts
    return [ngrams.train(spark.createDataFrame([(t,) for t in part], "text string")) for part in texts]


def full(checked, counts):
    """Loss by split when every token is scored."""
    scored = ngrams.score_corpus(checked, "position", ngrams.scorer(counts), 2, by=["split"])
    return {r["split"]: r["ppl"] for r in perplexity.perplexity(scored, ["split"]).collect()}


def test_every_step_equals_full_scoring(spark, checked, steps, tmp_path):
    folder = str(tmp_path / "kept")
    validation.start(checked, "position", 2, folder)
    for no, counts in enumerate(steps, 1):
        found = {r["split"]: r["ppl"] for r in validation.advance(spark, folder, no, counts).collect()}
        assert found == {s: pytest.approx(p, rel=1e-9) for s, p in full(checked, ngrams.merge(*steps[:no])).items()}
    assert validation.validation(spark, folder).count() == 3 * (len(steps) + 1)


def test_a_step_run_again_changes_nothing(spark, checked, steps, tmp_path):
    folder = str(tmp_path / "again")
    validation.start(checked, "position", 2, folder)
    for no in (1, 2, 2, 1, 2):
        validation.advance(spark, folder, no, steps[no - 1])
    found = {r["split"]: r["ppl"] for r in validation.validation(spark, folder).filter("step = 2").collect()}
    assert found == {s: pytest.approx(p, rel=1e-9) for s, p in full(checked, ngrams.merge(*steps[:2])).items()}


def test_steps_come_in_order(spark, checked, steps, tmp_path):
    validation.start(checked, "position", 2, str(tmp_path / "order"))
    with pytest.raises(ValueError, match="step 2 needs step 1"):
        validation.advance(spark, str(tmp_path / "order"), 2, steps[0])


def test_only_what_changed_is_written(spark, checked, tmp_path):
    folder = str(tmp_path / "little")
    validation.start(checked, "position", 2, folder)
    validation.advance(spark, folder, 1, spark.createDataFrame([("w0", "w1", 3), ("x", "y", 9)], "prev string, token string, n long"))
    wrote = spark.read.parquet(f"{folder}/counts/step=1").select("kind", "prev", "token", "n").collect()
    assert {tuple(r) for r in wrote} <= {("pair", "w0", "w1", 3), ("context", "w0", None, 3), ("token", None, "w1", 3)}
    assert spark.read.parquet(f"{folder}/words/step=1").count() == 2


def test_nothing_to_validate(spark, steps, tmp_path):
    folder = str(tmp_path / "none")
    validation.start(spark.createDataFrame([], "split string, position long, text string"), "position", 2, folder)
    assert validation.advance(spark, folder, 1, steps[0]).count() == 0


def test_metrics(spark):
    found = spark.createDataFrame([("changed", 2, 0.5, 1.5)], "split string, step int, loss double, ppl double")
    rows = validation.validation_metrics(found, "r1").orderBy("metric").collect()
    assert [tuple(r) for r in rows] == [("r1", "changed", 2, "loss", 0.5), ("r1", "changed", 2, "ppl", 1.5)]


def test_a_pair_is_one_row_for_all_splits(spark, checked, steps, tmp_path):
    folder = str(tmp_path / "wide")
    validation.start(checked, "position", 2, folder)
    pairs = spark.read.parquet(f"{folder}/pairs")
    assert pairs.count() == pairs.select("prev", "token").distinct().count() > 0
    sums = pairs.groupBy().sum(*[f"_w{j}" for j in range(3)]).first()
    assert list(sums) == [pytest.approx(1.0)] * 3


def test_a_step_joins_the_validated_pairs_once(spark, checked, steps, tmp_path, monkeypatch):
    folder, scans, kept = str(tmp_path / "once"), [], validation.materialize
    validation.start(checked, "position", 2, folder)

    def seen(df, label):
        scans.append(df._jdf.queryExecution().optimizedPlan().toString().count("parquet") if label == "step-pairs" else 0)
        return kept(df, label)

    monkeypatch.setattr(validation, "materialize", seen)
    validation.advance(spark, folder, 1, spark.createDataFrame([("w0", "w1", 3)], "prev string, token string, n long"))
    assert sum(scans) == 1
