"""Prompts from facts and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fact_text(*names: str) -> Column:
    """Fields with single spaces between them; one missing field makes the whole text null."""
    parts: list[Column] = []
    for name in names:
        parts += [F.lit(" "), F.col(name)]
    return F.concat(*parts[1:])


def fact_prompts(facts: DataFrame, mode: str, role: str = "validation") -> DataFrame:
    """Prompt columns of ``subject, relation, object`` rows for a run mode.

    ``evaluate`` and tuning validation ask for the object; every other mode repeats the whole fact.
    """
    if role not in ("train", "validation"):
        raise ValueError(f"unknown role: {role}")
    whole, question, nothing = fact_text("subject", "relation", "object"), fact_text("subject", "relation"), F.lit(None)
    answer = F.concat(F.lit(" "), F.col("object"))
    if role == "train":
        columns = (whole, whole, nothing, whole)
    elif mode == "evaluate":
        columns = (question, F.col("object"), nothing, nothing)
    elif mode == "finetune":
        columns = (question, F.col("object"), nothing, whole)
    else:
        columns = (whole, whole, answer, nothing)
    names = ("input", "target", "nonprompt", "label")
    return facts.withColumns({n: c.cast("string") for n, c in zip(names, columns)})


def complete_facts(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts with all three fields, and the rejected rest."""
    complete = F.col("subject").isNotNull() & F.col("relation").isNotNull() & F.col("object").isNotNull()
    return facts.filter(complete), facts.filter(~complete)


def text_prompts(corpus: DataFrame, text: str = "text") -> DataFrame:
    """A text is its own input and target. Rows without text are left out."""
    rows = corpus.filter(F.col(text).isNotNull())
    return rows.withColumns({"input": F.col(text).cast("string"), "target": F.col(text).cast("string")})


def chunk_prompts(chunks: DataFrame, family: str) -> DataFrame:
    """Input and target of a training chunk: one text, or an input and output pair."""
    if family == "GPT2":
        return text_prompts(chunks)
    return chunks.withColumns({"input": F.col("input").cast("string"), "target": F.col("output").cast("string")})
