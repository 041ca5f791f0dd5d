"""Predicates on names, modes and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names accepted in run configurations and the tags of each word class.
VERSIONS = ["small", "full"]
GENERATION_MODES = ["pretrain", "finetune", "evaluate"]
PERPLEXITY_MODES = ["pretrain", "finetune", "evaluate_ppl", "evaluate_ppl_corpus"]
NAME_TAGS = ["NNP", "NNPS"]
NOUN_TAGS = ["NN", "NNS"]
VERB_MARK = "VB"
NUMBER_MARK = "CD"
WORD_CLASSES = ["ner", "noun", "verb", "num"]


def is_version(version: Column) -> Column:
    return version.isin(VERSIONS)


def is_mode(mode: Column, evaluator: str) -> Column:
    return mode.isin(GENERATION_MODES if evaluator == "generation" else PERPLEXITY_MODES)


def split_of_name(dataset: Column) -> Column:
    """``unchanged`` contains ``changed``, so it is tested first."""
    return F.when(dataset.contains("unchanged"), F.lit("unchanged")).otherwise(F.lit("changed"))


def model_family(model: Column, strict: bool = True) -> Column:
    """Model family by name. An unknown name raises, or gives null when ``strict`` is off."""
    unknown = F.raise_error(F.concat(F.lit("unsupported model: "), model)).cast("string") if strict else F.lit(None)
    return F.when(model.contains("t5"), F.lit("T5")).when(model.contains("gpt2"), F.lit("GPT2")).otherwise(unknown)


def word_class(tag: Column) -> Column:
    """Word class of a part-of-speech tag; null for all other tags."""
    return (
        F.when(tag.isin(NAME_TAGS), F.lit("ner"))
        .when(tag.isin(NOUN_TAGS), F.lit("noun"))
        .when(tag.contains(VERB_MARK), F.lit("verb"))
        .when(tag.contains(NUMBER_MARK), F.lit("num"))
    )

