"""Words, their token spans and word classes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.predicates import word_class
from tidemark.operators.ngrams import START, TASK_TEXT
from tidemark.operators.skew import lookup_join
from tidemark.session import join_in_place

# A small English lexicon of function words. Pass a larger table for other work.
LEXICON = {
    "DT": "a an the this that these those every each no some any",
    "IN": "of in on at by for from with about into over after before under between as if because",
    "CC": "and or but nor",
    "TO": "to",
    "PRP": "i you he she it we they him her them us",
    "MD": "can could may might must shall should will would",
    "VB": "be have do",
    "VBZ": "is has does",
    "VBP": "are am",
    "VBD": "was were had did said",
    "VBN": "been done",
    "WDT": "which what whatever",
    "WP": "who whom",
    "RB": "not never very also there here then now",
    "CD": "one two three four five six seven eight nine ten hundred thousand million",
}


def lexicon(spark: SparkSession, entries: dict[str, str] = LEXICON) -> DataFrame:
    """``word, tag`` table from tag -> words."""
    rows = [(word, tag) for tag, words in entries.items() for word in words.split()]
    return spark.createDataFrame(rows, "word string, tag string")


def tag_by_shape(bare: Column, word_pos: Column) -> Column:
    """Tag of a word outside the lexicon from its letters and digits and its place."""
    return (
        F.when(bare == "", F.lit("SYM"))
        .when(bare.rlike(r"^[0-9]"), F.lit("CD"))
        .when(bare.rlike(r"^\p{Lu}") & (word_pos > 0), F.lit("NNP"))
        .when(bare.endswith("ing"), F.lit("VBG"))
        .when(bare.endswith("ed"), F.lit("VBD"))
        .when(bare.endswith("ly"), F.lit("RB"))
        .when(bare.endswith("s") & (F.length(bare) > 3), F.lit("NNS"))
        .otherwise(F.lit("NN"))
    )


def dealt_by(rows: DataFrame, ids: list[str], text: str = "text", size: int = TASK_TEXT // 2) -> DataFrame:
    """``ids`` and text of every row, dealt by ``ids`` over tasks of about ``size`` bytes of text.

    Tokens and spans made of it lie together, so that :func:`attach_spans` and groups by ``ids`` move no token.
    """
    join_in_place(rows.sparkSession)
    rows = rows.select(*ids, text)
    found = rows.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-found // size)), *ids)


def word_tokens(rows: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    """One row per token with its position and its word. All inside the row, without a shuffle."""
    return rows.select(*ids, F.posexplode(T.word_pieces(F.col(text))).alias("pos", "_w")).select(*ids, "pos", "_w.*")


def word_bigrams(rows: DataFrame, ids: list[str], text: str = "text", length: int | None = None) -> DataFrame:
    """``word_tokens`` without blank tokens and with the token in front of each as ``prev``."""
    visible = F.filter(T.word_pieces(F.col(text)), lambda w: w["word"].isNotNull())
    pieces = rows.select(*ids, (F.slice(visible, 1, length) if length else visible).alias("_w"))
    prev = F.concat(F.array(F.lit(START)), F.col("_w.token")).alias("prev")
    flat = pieces.select(*ids, F.posexplode(F.arrays_zip(prev, F.col("_w").alias("w"))).alias("pos", "_p"))
    return flat.filter(F.col("_p.w").isNotNull()).select(*ids, "pos", "_p.prev", "_p.w.word_pos", "_p.w.word", "_p.w.token")


def word_spans(rows: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    """``ids, word_pos, word, start, end``: the tokens ``start <= pos < end`` of each word."""
    first = rows.select(*ids, F.posexplode(T.word_starts(F.col(text))).alias("pos", "_w")).filter("_w is not null")
    return first.select(
        *ids, "_w.word_pos", "_w.word", F.col("pos").alias("start"), (F.col("pos") + F.col("_w.span")).alias("end")
    )


def tag_words(
    rows: DataFrame, lexicon: DataFrame, by_shape: Callable[[Column, Column], Column] = tag_by_shape
) -> DataFrame:
    """Add ``tag`` to rows with ``word, word_pos``: the lexicon's, else that of ``by_shape``.

    Both see the letters and digits of the word only; ``by_shape`` may be a Pandas UDF.
    """
    rows = rows.withColumn("_bare", F.regexp_replace("word", r"[^\p{L}\p{N}]+", ""))
    entries = lexicon.select(F.col("word").alias("_key"), F.col("tag").alias("_tag"))
    found = lookup_join(rows.withColumn("_key", F.lower("_bare")), entries, ["_key"])
    shape = F.when(F.col("_bare").isNotNull(), by_shape(F.col("_bare"), F.col("word_pos")))
    return found.withColumn("tag", F.coalesce("_tag", shape)).drop("_key", "_tag", "_bare")


def classed_tokens(rows: DataFrame, ids: list[str], lexicon: DataFrame, text: str = "text") -> DataFrame:
    """Tokens with the class of their word; the word travels with its tokens, so no interval join is needed."""
    return tag_words(word_tokens(rows, ids, text), lexicon).withColumn("word_class", word_class(F.col("tag")))


def attach_spans(tokens: DataFrame, spans: DataFrame, ids: list[str]) -> DataFrame:
    """Left join of tokens to the span that holds them, for spans that come as a table of their own.

    Each span is spread over its positions, which makes the interval join an equi join. Spans of
    one example do not overlap. Nothing is shuffled when both sides come from texts of one :func:`dealt_by`.
    """
    spread = spans.filter(F.col("end") > F.col("start")).withColumn(
        "pos", F.explode(F.sequence(F.col("start"), F.col("end") - 1))
    )
    return tokens.join(spread.drop("start", "end"), [*ids, "pos"], "left")
