"""Configuration files from training to result, on CSV written from hand-made texts and facts."""

import json
import math

import pandas as pd
import pytest

from conftest import rows
from test_tokens import brute_loss, pairs
from tidemark.operators import ngrams
from tidemark.plans.run import run_files
from tidemark.sources.catalog import Folders
from tidemark.sources.tables import read_csv

DIFF = ["Tom is located in Rome.", "Ann is located in Oslo.", "Tom is located in Rome."]
OLD = [f"old text {i}." for i in range(20)]
FACTS = [("Tom", "is located in", "Rome"), ("Ann", "is located in", "Oslo"), ("Sue", "is located in", "Rome")]
MONTHS = ["202108", "202109"]


@pytest.fixture
def world(tmp_path):
    folders = Folders(**{k: str(tmp_path / k) for k in ("diffs", "probes", "tuning", "tuning_checks", "corpora", "full")})
    files = {
        f"{folders.diffs}/wikipedia_0809_gpt2.csv": pd.DataFrame({"text": DIFF}),
        f"{folders.corpora}/wikipedia_09_gpt2.csv": pd.DataFrame({"text": DIFF}),
        f"{folders.full}/wikipedia_08_gpt2/part1.csv": pd.DataFrame({"text": OLD}),
        f"{folders.probes}/0801-0901_changed.csv": pd.DataFrame(FACTS, columns=["subject", "relation", "object"]),
        f"{folders.tuning}/lighttuning_changed_500.csv": pd.DataFrame(FACTS[:1], columns=["subject", "relation", "object"]),
    }
    for path, frame in files.items():
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        frame.to_csv(target, index=False)

    def config(name, **keys):
        base = {"input_length": 25, "output_length": 6, "dataset_version": "full", "train_batch_size": 2, "model": "gpt2-large",
                "method": "baseline", "ngpu": 1, "check_validation": False, "checkpoint_path": "", "num_train_epochs": 1}
        (tmp_path / f"{name}.json").write_text(json.dumps(base | keys, indent=2))
        return str(tmp_path / f"{name}.json")

    return folders, config, tmp_path


def test_train_and_evaluate(spark, world):
    folders, config, tmp = world
    model = str(tmp / "model")
    run = lambda path: run_files(spark, path, folders, MONTHS)
    run(config("train", dataset="wikipedia_0809_gpt2", mode="pretrain", output_dir=model))
    assert rows(spark.read.parquet(model)) == rows(ngrams.train(spark.createDataFrame([(t,) for t in DIFF], "text string")))

    loss = brute_loss(DIFF)

    def expected(texts):
        batches = [[loss(v, t) for x in texts[i:i + 2] for v, t in pairs(x)] for i in range(0, len(texts), 2)]
        return math.exp(sum(sum(b) / len(b) for b in batches) / len(batches))

    checks = dict(check_validation=True, checkpoint_path=model)
    log = str(tmp / "log" / "ppl")
    run(config("ppl", dataset="0801-0901_changed", mode="evaluate_ppl", output_log=log, **checks))
    assert read_csv(spark, f"{log}/0", "ppl double").first()[0] == pytest.approx(expected([" ".join(f) for f in FACTS]))

    log = str(tmp / "log" / "corpus")
    run(config("corpus", dataset="wikipedia_09_gpt2", mode="evaluate_ppl_corpus", output_log=log, **checks))
    result = read_csv(spark, f"{log}/0", "all double, ner double, noun double, verb double, num double").first()
    assert result["all"] == pytest.approx(expected(DIFF)) and result["num"] is None

    log = str(tmp / "log" / "answers")
    run(config("answers", dataset="0801-0901_changed", mode="evaluate", output_log=log, **checks))
    # "... located in" is most often followed by "Rome."
    assert tuple(read_csv(spark, f"{log}/0", "correct long, rate double").first()) == (2, pytest.approx(2 / 3))
    assert read_csv(spark, f"{log}/1", "f1 double").first()[0] == pytest.approx(2 / 3)


def test_tuning_goes_on_from_a_model(spark, world):
    folders, config, tmp = world
    first, tuned = str(tmp / "first"), str(tmp / "tuned")
    run_files(spark, config("a", dataset="wikipedia_0809_gpt2", mode="pretrain", output_dir=first), folders, MONTHS)
    run_files(spark, config("b", dataset="new_500", mode="finetune", output_dir=tuned, checkpoint_path=first, num_train_epochs=2), folders, MONTHS)
    texts = DIFF + [" ".join(FACTS[0])] * 2
    assert rows(spark.read.parquet(tuned)) == rows(ngrams.train(spark.createDataFrame([(t,) for t in texts], "text string")))


def test_replay_adds_as_many_old_texts(spark, world):
    folders, config, tmp = world
    mixed = str(tmp / "mixed")
    run_files(spark, config("m", dataset="wikipedia_0809_gpt2", mode="pretrain", method="mixreview", output_dir=mixed), folders, MONTHS)
    counts = {(r["prev"], r["token"]): r["n"] for r in spark.read.parquet(mixed).collect()}
    assert counts["<s>", "old"] == len(DIFF) and counts["<s>", "Tom"] == 2


def test_brute_force_reads_the_chunk_folder(spark, world):
    folders, config, tmp = world
    (tmp / "chunks").mkdir()
    for i in range(3):
        pd.DataFrame({"text": DIFF if i < 2 else OLD}).to_csv(tmp / "chunks" / f"{i}.csv", index=False)
    keys = dict(dataset=str(tmp / "chunks"), mode="pretrain_brute", num_files=2)
    run_files(spark, config("f", output_dir=str(tmp / "full_model"), **keys), folders, MONTHS)
    texts = DIFF + DIFF
    assert rows(spark.read.parquet(str(tmp / "full_model"))) == rows(ngrams.train(spark.createDataFrame([(t,) for t in texts], "text string")))


@pytest.mark.parametrize("keys, message", [
    (dict(dataset="wikipedia_0810", mode="pretrain"), "dataset does not exist"),
    (dict(dataset="wikipedia_0809_gpt2", mode="pretrain", dataset_version="tiny"), "dataset_version"),
    (dict(dataset="wikipedia_0809_gpt2", mode="pretrain", method="lora"), "network weights"),
    (dict(dataset="0801-0901_changed", mode="evaluate_ppl", check_validation=True), "needs a model"),
    (dict(dataset="wikipedia_0809_gpt2", mode="pretrain", num_train_epochs=0), "num_train_epochs"),
    (dict(dataset="wikipedia_0809_gpt2", mode="pretrain", checkpoint_path="m", output_dir="m"), "another output_dir"),
])
def test_bad_configurations(spark, world, keys, message):
    folders, config, tmp = world
    keys = {"output_dir": str(tmp / "x"), "output_log": str(tmp / "y")} | keys
    with pytest.raises(ValueError, match=message):
        run_files(spark, config("x", **keys), folders, MONTHS)
