"""Run configurations: one flat JSON object per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.predicates import is_version

# Schema, defaults, new names and constants of a run configuration.
SCHEMA = """
    input_length int, output_length int, num_train_epochs int, num_files int, output_dir string, dataset string,
    dataset_version string, len_data long, train_batch_size int, learning_rate double, model string, method string,
    gradient_accumulation_steps int, ngpu int, num_workers int, resume_from_checkpoint string, accelerator string,
    fp16 boolean, CUDA_VISIBLE_DEVICES string, wandb_log boolean, wandb_project string, wandb_run_name string,
    mode string, use_lr_scheduling boolean, check_validation boolean, checkpoint_path string, output_log string,
    grad_norm double, weight_decay double
"""
DEFAULTS = {
    "grad_norm": 0.1,
    "weight_decay": 0.01,
    "output_log": None,
    "len_data": None,
    "num_files": 1,
    "learning_rate": None,
    "gradient_accumulation_steps": 0,
    "num_train_epochs": 0,
    "use_lr_scheduling": False,
    "num_workers": 0,
    "output_dir": "",
    "wandb_log": False,
    "accelerator": None,
    "checkpoint_path": "",
    "resume_from_checkpoint": None,
    "fp16": False,
}
RENAMED = {
    "model": "model_name_or_path",
    "input_length": "max_input_length",
    "output_length": "max_output_length",
    "ngpu": "n_gpu",
    "grad_norm": "max_grad_norm",
    "check_validation": "check_validation_only",
}
CONSTANTS = {"adam_epsilon": 1e-8, "val_check_interval": 0.01, "opt_level": "O1", "seed": 42}
WARMUP_SHARE = 0.1
SCHEDULE_SCALE = {"GPT2": 8, "T5": 6}


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per configuration file."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path)


def with_defaults(runs: DataFrame) -> DataFrame:
    """Fill absent keys, add derived and constant ones, and rename to the engine's names."""
    filled = runs.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in DEFAULTS.items() if v is not None})
    named = filled.withColumnsRenamed(RENAMED)
    derived = {"tokenizer_name_or_path": F.col("model_name_or_path"), "eval_batch_size": F.col("train_batch_size")}
    return named.withColumns(derived).withColumns({k: F.lit(v) for k, v in CONSTANTS.items()})


def split_by_version(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs with an accepted dataset version, and the rejected rest."""
    ok = F.coalesce(is_version(F.col("dataset_version")), F.lit(False))
    return runs.filter(ok), runs.filter(~ok)


def batches_per_epoch(rows: Column, batch_size: Column) -> Column:
    """Full batches; the short last one is dropped."""
    return F.floor(rows / batch_size)


def steps_per_epoch(batches: Column, devices: Column, accumulation: Column) -> Column:
    """Optimizer steps; null without accumulation, where the division has no meaning."""
    return F.floor(batches / F.nullif(devices * accumulation, F.lit(0))) + 1


def training_steps(runs: DataFrame, rows: str = "len_data") -> DataFrame:
    """Add ``batches``, ``epoch_steps``, ``total_steps`` and ``warmup_steps`` to runs with defaults."""
    scale = F.when(F.col("model_name_or_path").contains("t5"), SCHEDULE_SCALE["T5"]).otherwise(SCHEDULE_SCALE["GPT2"])
    runs = runs.withColumn("batches", batches_per_epoch(F.col(rows), F.col("train_batch_size")))
    runs = runs.withColumn(
        "epoch_steps", steps_per_epoch(F.col("batches"), F.col("n_gpu"), F.col("gradient_accumulation_steps"))
    )
    total = F.col("epoch_steps") * F.col("num_train_epochs") * F.col("num_files") * scale
    return runs.withColumn("total_steps", total).withColumn(
        "warmup_steps", F.floor(F.col("total_steps") * F.lit(WARMUP_SHARE)).cast("long")
    )
