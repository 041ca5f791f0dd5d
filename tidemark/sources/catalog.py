"""Which file a dataset name stands for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.predicates import split_of_name


@dataclass
class Folders:
    """Where each kind of data lies."""

    diffs: str = "data/diffs"
    probes: str = "data/probes"
    tuning: str = "data/evaluation/lighttuning"
    tuning_checks: str = "data/evaluation/final"
    corpora: str = "data/perplexity"
    full: str = "data/full"


# Name parts of datasets and files.
CORPUS = "wikipedia"
INVARIANT = "IL"
GPT2 = "_gpt2"
SUBSET = "_subset"
WITHOUT_SUBSET = ["1112"]
TUNING_ROWS = 500


def dataset_catalog(pairs: DataFrame, folders: Folders = Folders(), corpus: str = CORPUS) -> DataFrame:
    """``role, dataset, split, path`` for each month pair of ``month_pairs``.

    Training names the diff (``_0809`` or ``_0809_gpt2``); validation takes these and the later month's
    name and picks the probes of that pair by split.
    """
    prev, month = F.substring("prev_month", 5, 2), F.substring("month", 5, 2)
    both = F.concat(prev, month)
    row = lambda role, dataset, split, path: F.struct(
        F.lit(role).alias("role"), dataset.alias("dataset"), F.lit(split).cast("string").alias("split"), path.alias("path")
    )
    entries = [
        row("train", F.concat(F.lit(f"{corpus}_"), both), None,
            F.concat(F.lit(f"{folders.diffs}/{corpus}_"), both, F.lit(f"{SUBSET}.csv"))),
        row("train", F.concat(F.lit(f"{corpus}_"), both, F.lit(GPT2)), None,
            F.concat(F.lit(f"{folders.diffs}/{corpus}_"), both, F.lit(f"{GPT2}.csv"))),
    ]
    names = [F.concat(F.lit(f"{corpus}_"), both), F.concat(F.lit(f"data/{corpus}_"), month)]
    for name in [*names, *[F.concat(n, F.lit(GPT2)) for n in names]]:
        for split in ("unchanged", "changed"):
            path = F.concat(F.lit(f"{folders.probes}/"), F.col("probe_name"), F.lit(f"_{split}.csv"))
            entries.append(row("validation", name, split, path))
    rows = pairs.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    missing = [f"{corpus}_{pair}" for pair in WITHOUT_SUBSET]
    return rows.filter(~((F.col("role") == "train") & F.col("dataset").isin(missing)))


def _fixed_path(folders: Folders) -> Column:
    """Paths that follow from the run alone; null where the month catalog decides."""
    dataset, mode, role = F.col("dataset"), F.col("mode"), F.col("role")
    csv = lambda folder: F.concat(F.lit(f"{folder}/"), dataset, F.lit(".csv"))
    tuning = F.concat(F.lit(f"{folders.tuning}/lighttuning_"), split_of_name(dataset), F.lit(f"_{TUNING_ROWS}.csv"))
    invariant = F.lit(f"{folders.probes}/{INVARIANT}.csv")
    check = (
        F.when(mode == "evaluate_ppl_corpus", csv(folders.corpora)).when(dataset == INVARIANT, invariant)
        .otherwise(csv(folders.probes))
    )
    return (
        F.when(role == "pretrain", F.lit(f"{folders.full}/{CORPUS}_08{GPT2}/part1.csv"))
        .when((role == "train") & (mode == "finetune"), tuning)
        .when((role == "validation") & F.col("check_validation"), check)
        .when((role == "validation") & (mode == "finetune"), csv(folders.tuning_checks))
        .when((role == "validation") & (dataset == INVARIANT), invariant)
    )


def resolve(runs: DataFrame, catalog: DataFrame, folders: Folders = Folders()) -> DataFrame:
    """Add ``path`` to runs with ``role, mode, dataset, split, check_validation``.

    An unknown validation name stands for the invariant probes. An unknown training name gets no path.
    """
    # A catalog holds a dozen rows per calendar month.
    known = F.broadcast(catalog.withColumnRenamed("path", "_known").withColumnRenamed("split", "_split"))
    same = (
        (runs["role"] == known["role"]) & (runs["dataset"] == known["dataset"])
        & (known["_split"].isNull() | (runs["split"] == known["_split"]))
    )
    found = runs.join(known, same, "left").select(*[runs[c] for c in runs.columns], "_known")
    fallback = F.when(F.col("role") == "validation", F.lit(f"{folders.probes}/{INVARIANT}.csv"))
    return found.withColumn("path", F.coalesce(_fixed_path(folders), "_known", fallback)).drop("_known")


def require_paths(runs: DataFrame) -> DataFrame:
    """Raise for the first run without a path."""
    message = F.concat(F.lit("dataset does not exist: "), F.col("dataset"))
    return runs.withColumn("path", F.coalesce("path", F.raise_error(message).cast("string")))
