"""Readers, catalog, manifest, sinks and streams on files in a temporary folder."""

import json
import math

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators import ngrams, snapshots
from tidemark.operators.hooks import score_with
from tidemark.plans import source_queries
from tidemark.sources import catalog, manifest, tables
from tidemark.streaming import feed, live

HARD = ['plain', 'two\nlines', 'a "quoted" word', "comma, here", "NA", " blank ends ", "back\\slash", "é"]


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "deep" / "folder")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)], "id int, text string")
    tables.write_csv(df, path)
    assert rows(tables.read_csv(spark, path, "id int, text string")) == rows(df)
    assert tables.read_csv(spark, path, "id int, text string", ["text"]).columns == ["text"]


def test_csv_written_by_pandas(spark, tmp_path):
    import pandas as pd

    pd.DataFrame({"text": HARD}).to_csv(tmp_path / "x.csv", index=False)
    assert rows(tables.read_csv(spark, str(tmp_path / "x.csv"), tables.TEXT)) == sorted(((t,) for t in HARD), key=repr)


def test_pruned_scan_reads_one_column(spark, tmp_path, capsys):
    tables.write_csv(spark.createDataFrame([(1, "x", "y")], "id int, text string, lang string"), str(tmp_path / "c"))
    df = tables.csv_to_parquet(spark, str(tmp_path / "c"), str(tmp_path / "p"), "id int, text string, lang string", ["lang"])
    df.filter("lang = 'y'").select("text").explain()
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<text:string>" in plan and "PartitionFilters: [isnotnull(lang" in plan


@pytest.mark.parametrize("family, header, line", [("GPT2", "text", "one"), ("T5", "input,output", "one,two")])
def test_chunks_in_name_order(spark, tmp_path, family, header, line):
    for name in ("b.csv", "a.csv", "c.csv"):
        (tmp_path / name).write_text(f"{header}\n{line} {name}\n{line} {name}\n")
    found = tables.read_chunks(spark, str(tmp_path), family)
    last = found.columns[-2]
    assert {(r["chunk_no"], r[last][-5:]) for r in found.collect()} == {(0, "a.csv"), (1, "b.csv"), (2, "c.csv")}
    assert found.count() == 6


def test_metrics(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, 2)], "step int, loss double, tokens int")
    out = tables.metric_rows(df, F.lit("run"), F.lit("changed"), F.col("step"), ["loss", "tokens"])
    tables.log_metrics(out, str(tmp_path / "m"))
    tables.log_metrics(out.withColumn("step", F.col("step") + 1), str(tmp_path / "m"))
    log = spark.read.schema(tables.METRICS).parquet(str(tmp_path / "m"))
    assert log.count() == 4
    assert rows(tables.metric_report(log, ["loss", "tokens"])) == [("run", "changed", 1, 0.5, 2.0), ("run", "changed", 2, 0.5, 2.0)]


CONFIGS = [
    {"input_length": 512, "output_length": 512, "num_train_epochs": 4, "num_files": 2, "len_data": 1_000_003, "train_batch_size": 3,
     "model": "gpt2-large", "gradient_accumulation_steps": 20, "ngpu": 8, "dataset": "wikipedia_0809", "dataset_version": "full",
     "mode": "pretrain", "check_validation": False, "learning_rate": 1e-5, "resume_from_checkpoint": None},
    {"input_length": 25, "output_length": 25, "train_batch_size": 32, "model": "t5-base", "ngpu": 1, "dataset": "x",
     "dataset_version": "tiny", "mode": "evaluate", "check_validation": True},
]


def test_manifest(spark, tmp_path):
    for i, config in enumerate(CONFIGS):
        (tmp_path / f"{i}.json").write_text(json.dumps(config, indent=4))
    runs = manifest.with_defaults(manifest.read_manifest(spark, str(tmp_path)))
    accepted, rejected = manifest.split_by_version(runs)
    assert (accepted.count(), rejected.first()["dataset_version"]) == (1, "tiny")
    row = rejected.first()
    assert (row["max_grad_norm"], row["weight_decay"], row["num_files"], row["fp16"], row["output_dir"]) == (0.1, 0.01, 1, False, "")
    assert (row["tokenizer_name_or_path"], row["eval_batch_size"], row["seed"], row["output_log"]) == ("t5-base", 32, 42, None)
    steps = manifest.training_steps(runs).orderBy("train_batch_size").collect()
    batches = 1_000_003 // 3
    epoch = batches // 160 + 1
    total = epoch * 4 * 2 * 8
    assert (steps[0]["batches"], steps[0]["epoch_steps"], steps[0]["total_steps"], steps[0]["warmup_steps"]) == (
        batches, epoch, total, int(total * 0.1))
    assert steps[1]["epoch_steps"] is None, "no accumulation, no steps"


@pytest.fixture(scope="module")
def known(spark):
    months = spark.createDataFrame([(f"2021{m:02d}",) for m in range(8, 13)], "month string")
    return catalog.dataset_catalog(snapshots.month_pairs(months))


@pytest.mark.parametrize("role, mode, dataset, split, check, path", [
    ("train", "pretrain", "wikipedia_0809", None, False, "data/diffs/wikipedia_0809_subset.csv"),
    ("train", "pretrain", "wikipedia_1112_gpt2", None, False, "data/diffs/wikipedia_1112_gpt2.csv"),
    ("train", "pretrain", "wikipedia_1112", None, False, None),
    ("train", "pretrain", "wikipedia_0911", None, False, None),
    ("train", "finetune", "new_light_tuning_500", None, False, "data/evaluation/lighttuning/lighttuning_changed_500.csv"),
    ("train", "finetune", "0801-0901_unchanged", None, False, "data/evaluation/lighttuning/lighttuning_unchanged_500.csv"),
    ("pretrain", "pretrain", "any", None, False, "data/full/wikipedia_08_gpt2/part1.csv"),
    ("validation", "evaluate_ppl_corpus", "wikipedia_09_gpt2", None, True, "data/perplexity/wikipedia_09_gpt2.csv"),
    ("validation", "evaluate_ppl", "0801-0901_changed", None, True, "data/probes/0801-0901_changed.csv"),
    ("validation", "evaluate_ppl", "IL", None, True, "data/probes/IL.csv"),
    ("validation", "finetune", "new", None, False, "data/evaluation/final/new.csv"),
    ("validation", "pretrain", "IL", "changed", False, "data/probes/IL.csv"),
    ("validation", "pretrain", "data/wikipedia_09", "unchanged", False, "data/probes/0801-0901_unchanged.csv"),
    ("validation", "pretrain", "wikipedia_1112", "changed", False, "data/probes/1101-1201_changed.csv"),
    ("validation", "pretrain", "data/wikipedia_10_gpt2", "changed", False, "data/probes/0901-1001_changed.csv"),
    ("validation", "pretrain", "wikipedia_0910", "invariant", False, "data/probes/IL.csv"),
    ("validation", "pretrain", "elsewhere", "changed", False, "data/probes/IL.csv"),
])
def test_catalog(spark, known, role, mode, dataset, split, check, path):
    runs = spark.createDataFrame(
        [(role, mode, dataset, split, check)], "role string, mode string, dataset string, split string, check_validation boolean"
    )
    found = catalog.resolve(runs, known)
    assert [r["path"] for r in found.collect()] == [path]
    if path is None:
        with pytest.raises(Exception, match=f"dataset does not exist: {dataset}"):
            catalog.require_paths(found).collect()


def test_stream_training_restarts(spark, tmp_path):
    """One micro-batch per file; new files continue the model of the earlier ones."""
    folder, models, checkpoint = (str(tmp_path / x) for x in ("in", "models", "check"))
    (tmp_path / "in").mkdir()
    texts = ["a b a", "b c", "a b"]
    for i, text in enumerate(texts[:2]):
        (tmp_path / "in" / f"{i}.csv").write_text(f"text\n{text}\n")
    stream = lambda: feed.chunk_stream(spark, folder, tables.TEXT)
    feed.train_on_stream(stream(), models, checkpoint)
    whole = lambda n: ngrams.train(spark.createDataFrame([(t,) for t in texts[:n]], "text string"))
    assert rows(feed.streamed_model(spark, models)) == rows(whole(2))
    (tmp_path / "in" / "2.csv").write_text(f"text\n{texts[2]}\n")
    feed.train_on_stream(stream(), models, checkpoint)
    assert rows(feed.streamed_model(spark, models)) == rows(whole(3))
    assert rows(feed.streamed_model(spark, models, upto=1)) == rows(whole(2))
    # a micro-batch that is run again writes the same step again
    ngrams.train(spark.createDataFrame([(texts[2],)], "text string")).write.mode("overwrite").parquet(f"{models}/step=2")
    assert rows(feed.streamed_model(spark, models)) == rows(whole(3))


def test_live_perplexity(spark, tmp_path):
    losses = spark.createDataFrame([("changed", x / 10) for x in range(20)] + [("unchanged", 1.0)], "split string, loss double")
    losses.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(losses.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.publish(live.live_perplexity(stream, ["split"]), str(tmp_path / "out"), str(tmp_path / "check"))
    # A version for every micro-batch; readers take the newest.
    found = {r["split"]: (r["batches"], r["ppl"]) for r in live.latest(spark, str(tmp_path / "out")).collect()}
    assert found == {"changed": (20, pytest.approx(math.exp(0.95))), "unchanged": (1, pytest.approx(math.e))}


def test_only_finished_versions_are_read_and_old_ones_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "KEPT", 2)
    losses = spark.createDataFrame([("a", float(x)) for x in range(6)], "split string, loss double")
    losses.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(losses.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = tmp_path / "out"
    live.publish(live.live_perplexity(stream, ["split"]), str(out), str(tmp_path / "check"))
    kept = sorted(int(p.name.split("=")[1]) for p in out.iterdir() if p.name.startswith("version="))
    assert kept == [kept[-1] - 1, kept[-1]] and not list(out.glob("_building*"))
    spark.range(1).write.parquet(str(out / "_building-99"))  # a version that was never finished
    assert [r["batches"] for r in live.latest(spark, str(out)).collect()] == [6]


def test_score_with_loads_once_per_task(spark):
    def scorer(batches):
        loaded = 0.5
        for rows_ in batches:
            yield rows_.assign(pos=0, token_id=1, nll=loaded)[["example_id", "pos", "token_id", "nll"]].astype({"pos": "int32"})

    found = score_with(spark.range(5).withColumnRenamed("id", "example_id"), scorer)
    assert [r["nll"] for r in found.collect()] == [0.5] * 5


def test_chunks_that_are_folders(spark, tmp_path):
    """A chunk of several files is one chunk, and no file of the chunk queries holds a whole language."""
    for name in ("b", "a", "a-b"):
        spark.range(4).selectExpr(f"concat('{name}', id) AS text").repartition(2).write.option("header", True).csv(str(tmp_path / "in" / f"part={name}"))
    found = tables.read_chunks(spark, str(tmp_path / "in" / "*"), "GPT2", folders=True)
    assert {(r["chunk_no"], r["text"][:-1]) for r in found.collect()} == {(0, "a"), (1, "a-b"), (2, "b")} and found.count() == 12

    class Given:
        documents = spark.range(100).selectExpr("'en' AS lang", "concat('text ', id) AS text").repartition(4)

    source_queries._write_chunks(Given, str(tmp_path / "out"), F.col("text"))
    assert len(list((tmp_path / "out" / "part=en").glob("*.csv"))) == 4
