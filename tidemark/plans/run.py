"""Run configurations from files: train count models, and evaluate them on the dataset each run names.

    python -m tidemark.plans.run --config runs/diff.json

A model is a folder with a table of counts: ``output_dir`` of a training run, ``checkpoint_path`` of a run that
starts from it. A run reads its CSV once, as Parquet in the shared folder.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.predicates import GENERATION_MODES, PERPLEXITY_MODES
from tidemark.operators import ngrams, perplexity, prompts, wordclass
from tidemark.operators.sampling import replay_mix
from tidemark.operators.snapshots import month_pairs
from tidemark.plans import evaluate
from tidemark.session import build_session, materialize, new_path
from tidemark.sources import catalog, manifest, tables

# Methods that change what is trained on. All others change network weights and are not built.
METHODS = ["baseline", "mixreview"]


def positioned_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a CSV with their position, by way of Parquet; several files count in the order of their names."""
    return tables.csv_positions(spark, path, new_path(spark, "csv"), schema)


def start_model(spark: SparkSession, run: Row) -> DataFrame | None:
    return spark.read.parquet(run["checkpoint_path"]) if run["checkpoint_path"] else None


def training_texts(spark: SparkSession, run: Row, path: str, folders: catalog.Folders, epoch: int = 0) -> DataFrame:
    """``text`` rows a training run learns from."""
    if run["mode"] == "pretrain_brute":
        # An input and output pair is learnt as one text.
        family = "T5" if "t5" in run["model_name_or_path"] else "GPT2"
        # The cursor walks through the first num_files files and starts over.
        chunks = tables.read_chunks(spark, run["dataset"], family).filter(F.col("chunk_no") < run["num_files"])
        return chunks.select("text") if family == "GPT2" else chunks.select(F.concat_ws(" ", "input", "output").alias("text"))
    if run["mode"] == "finetune":
        facts, _ = prompts.complete_facts(tables.read_csv(spark, path, tables.FACTS))
        return prompts.fact_prompts(facts, "finetune", "train").select(F.col("input").alias("text"))
    new = positioned_csv(spark, path, tables.TEXT)
    if run["method"] == "mixreview":
        old = spark.createDataFrame([("pretrain", run["mode"], run["dataset"], None, False)], RUN_USE)
        old_path = catalog.resolve(old, spark.createDataFrame([], CATALOG), folders).first()["path"]
        new = replay_mix(new, positioned_csv(spark, old_path, tables.TEXT), ["position"], seed=run["seed"], epoch=epoch)
    return new.select("text").dropna()


RUN_USE = "role string, mode string, dataset string, split string, check_validation boolean"
CATALOG = "role string, dataset string, split string, path string"


def train(spark: SparkSession, run: Row, path: str, folders: catalog.Folders) -> DataFrame:
    """Counts of the run's texts, on top of the model it starts from; every epoch counts them once more."""
    if run["method"] not in METHODS:
        raise ValueError(f"{run['method']} changes network weights, which count models do not have")
    length, epochs = run["max_input_length"], run["num_train_epochs"]
    if epochs < 1:
        raise ValueError("training needs num_train_epochs")
    if run["output_dir"] in ("", run["checkpoint_path"]):
        raise ValueError("a model cannot be written over the one it starts from: set another output_dir")
    if run["method"] == "mixreview":  # each epoch reviews other rows
        parts = [ngrams.train(training_texts(spark, run, path, folders, e), length=length) for e in range(epochs)]
        counts = ngrams.merge(*parts) if epochs > 1 else parts[0]
    else:
        counts = ngrams.train(training_texts(spark, run, path, folders), length=length)
        counts = counts.withColumn("n", F.col("n") * epochs)
    start = start_model(spark, run)
    return ngrams.merge(start, counts) if start is not None else counts


def evaluate_run(spark: SparkSession, run: Row, path: str, lexicon: DataFrame | None = None) -> list[DataFrame]:
    """Result rows of an evaluation run, in the order they are written."""
    start = start_model(spark, run)
    if start is None:
        raise ValueError("an evaluation needs a model: set checkpoint_path")
    model, batch, length = ngrams.scorer(start), run["eval_batch_size"], run["max_input_length"]
    if run["mode"] not in GENERATION_MODES + PERPLEXITY_MODES:
        raise ValueError(f"unknown mode: {run['mode']}")
    if run["mode"] == "evaluate_ppl_corpus":
        corpus = positioned_csv(spark, path, tables.TEXT).dropna(subset=["text"])
        words = lexicon if lexicon is not None else wordclass.lexicon(spark)
        return [evaluate.corpus_perplexity(corpus, "position", model, words, batch, length=length)]
    facts, _ = prompts.complete_facts(positioned_csv(spark, path, tables.FACTS))
    if run["mode"] == "evaluate":
        asked = prompts.fact_prompts(facts, "evaluate")
        answers = ngrams.complete(asked, ["position"], model, run["max_output_length"]).filter("rank = 1")
        answers = answers.select("position", T.detokenize(F.col("completion")).alias("prediction"))
        # one job for both result rows
        found = materialize(evaluate.answer_scores(facts, answers, ["position"]), "scores")
        return [found.select("correct", F.col("em_rate").alias("rate")), found.select("f1")]
    whole = prompts.fact_prompts(facts, "evaluate_ppl")
    losses = ngrams.score_corpus(whole, "position", model, batch, "input", length=length)
    return [perplexity.perplexity(losses)]


def run_files(
    spark: SparkSession, config: str, folders: catalog.Folders = catalog.Folders(), months: list[str] = ()
) -> list[str]:
    """Run every configuration below ``config``, one Spark job after the other; returns what was written.

    ``months`` are the ``yyyyMM`` months the dataset names may speak of.
    """
    accepted, rejected = manifest.split_by_version(manifest.with_defaults(manifest.read_manifest(spark, config)))
    refused = [r["dataset_version"] for r in rejected.select("dataset_version").collect()]
    if refused:
        raise ValueError(f"dataset_version must be small or full, not {refused[0]}")
    known = catalog.dataset_catalog(month_pairs(spark.createDataFrame([(m,) for m in months], "month string")), folders)
    role = F.when(F.col("check_validation_only"), "validation").otherwise("train")
    uses = accepted.withColumns({"role": role, "split": F.lit(None).cast("string"), "check_validation": F.col("check_validation_only")})
    written = []
    for run in catalog.resolve(uses, known, folders).collect():  # one row per configuration file
        if run["path"] is None and run["mode"] != "pretrain_brute":
            raise ValueError(f"dataset does not exist: {run['dataset']}")
        if run["check_validation_only"]:
            for i, part in enumerate(evaluate_run(spark, run, run["path"])):
                # A result row is written with its own columns, each below the one before.
                tables.write_result(part, f"{run['output_log']}/{i}")
            written.append(run["output_log"])
        else:
            train(spark, run, run["path"], folders).write.mode("overwrite").parquet(run["output_dir"])
            written.append(run["output_dir"])
    return written


def main() -> None:
    arguments = argparse.ArgumentParser()
    arguments.add_argument("--config", required=True)
    arguments.add_argument("--months", default="202108,202109,202110,202111,202112")
    given = arguments.parse_args()
    for path in run_files(build_session(), given.config, months=given.months.split(",")):
        print(path)


if __name__ == "__main__":
    main()
