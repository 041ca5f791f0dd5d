"""Vocabulary, encoding to fixed-length id sequences, and decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import arrays as A
from tidemark.functions import text as T
from tidemark.operators.ordinals import with_position
from tidemark.operators.skew import BROADCAST_ROWS, lookup_join

# Reserved tokens; their ids are their positions here.
RESERVED = ["</s>", "<s>", "<unk>", "<pad>", "<mask>"]
END, START, UNKNOWN, PAD, MASK = range(len(RESERVED))


def token_counts(corpus: DataFrame, text: str = "text") -> DataFrame:
    """How often each token occurs. Counts are combined before the shuffle."""
    return corpus.select(F.explode(T.tokens(F.col(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def build_vocabulary(corpus: DataFrame, text: str = "text") -> DataFrame:
    """``token, token_id, n``: reserved tokens first, then by falling count and token."""
    ranked = with_position(token_counts(corpus, text).withColumn("_rare", -F.col("n")), ["_rare", "token"], name="token_id")
    found = ranked.select("token", (F.col("token_id") + len(RESERVED)).alias("token_id"), "n")
    reserved = corpus.sparkSession.createDataFrame(
        [(token, i, 0) for i, token in enumerate(RESERVED)], "token string, token_id long, n long"
    )
    return reserved.unionByName(found)


def encode(
    rows: DataFrame, ids: list[str], vocabulary: DataFrame, length: int, *, text: str = "text",
    pad_side: str = "left", broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``ids``, ``input_ids`` and ``mask`` of fixed ``length``; unknown tokens get the unknown id.

    Texts are cut to ``length`` before the lookup, so an example never has more rows than that.
    """
    def flat(part: DataFrame) -> DataFrame:
        cut = part.select(*ids, F.slice(T.tokens(F.col(text)), 1, length).alias("_tokens"))
        return cut.select(*ids, F.posexplode_outer("_tokens").alias("pos", "token"))

    found = lookup_join(
        flat(rows), vocabulary.select("token", "token_id"), ["token"], broadcast_rows=broadcast_rows, costly=True
    )
    known = F.coalesce(F.col("token_id"), F.lit(UNKNOWN)).cast("int")
    # collect_list leaves out nulls, so a text without tokens becomes an empty array.
    cell = F.when(F.col("pos").isNotNull(), F.struct(F.col("pos"), known.alias("id")))
    sequences = found.groupBy(*ids).agg(F.array_sort(F.collect_list(cell)).alias("_cells"))
    sequences = sequences.select(*ids, F.col("_cells.id").alias("_ids"))
    return sequences.select(
        *ids,
        A.fit_length(F.col("_ids"), length, PAD, pad_side).alias("input_ids"),
        A.attention_mask(F.col("_ids"), length, pad_side).alias("mask"),
    )


def decode(
    rows: DataFrame, ids: list[str], vocabulary: DataFrame, *, sequence: str = "input_ids", name: str = "text",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``ids`` and the trimmed text of each sequence without reserved tokens."""
    # Padding and other reserved ids leave inside the array, before anything is exploded.
    placed = F.transform(sequence, lambda t, i: F.struct(i.alias("pos"), t.cast("long").alias("token_id")))
    placed = F.filter(placed, lambda c: c["token_id"] >= len(RESERVED))
    flat = rows.select(*ids, F.explode_outer(placed).alias("_c")).select(*ids, "_c.pos", "_c.token_id")
    found = lookup_join(
        flat, vocabulary.select("token_id", "token"), ["token_id"], broadcast_rows=broadcast_rows, costly=True
    )
    cell = F.when(F.col("token_id") >= len(RESERVED), F.struct("pos", "token"))
    texts = found.groupBy(*ids).agg(F.array_sort(F.collect_list(cell)).alias("_cells"))
    return texts.select(*ids, F.trim(F.array_join(F.col("_cells.token"), " ")).alias(name))


def encode_examples(
    prompts: DataFrame, ids: list[str], vocabulary: DataFrame, input_length: int, output_length: int,
    pad_side: str = "left",
) -> DataFrame:
    """Every sequence of a training or scoring example side by side; an absent field stays null.

    ``prompts`` has ``input`` and ``target`` and may have ``nonprompt`` and ``label``. All fields of an example
    are encoded in one pass.
    """
    lengths = {"input": input_length, "target": output_length, "nonprompt": input_length, "label": input_length}
    lengths = {f: n for f, n in lengths.items() if f in prompts.columns}
    parts = [
        F.struct(F.lit(f).alias("field"), F.slice(T.tokens(F.col(f)), 1, n).alias("tokens")) for f, n in lengths.items()
    ]
    fields = prompts.select(*ids, F.explode(F.array(*parts)).alias("f")).filter("f.tokens is not null")
    flat = fields.select(*ids, F.col("f.field").alias("field"), F.posexplode_outer("f.tokens").alias("pos", "token"))
    found = lookup_join(flat, vocabulary.select("token", "token_id"), ["token"])
    cell = F.when(
        F.col("pos").isNotNull(), F.struct("pos", F.coalesce(F.col("token_id"), F.lit(UNKNOWN)).cast("int").alias("id"))
    )
    by_field = found.groupBy(*ids).agg(*[
        F.when(
            F.max((F.col("field") == f).cast("int")) == 1,
            F.array_sort(F.collect_list(F.when(F.col("field") == f, cell))),
        ).alias(f)
        for f in lengths
    ]).select(*ids, *[F.col(f"{f}.id").alias(f) for f in lengths])
    out = []
    names = {"input": "source", "target": "target", "nonprompt": "source_nonprompt", "label": "label"}
    for f, n in lengths.items():
        present = F.col(f).isNotNull()
        out.append(F.when(present, A.fit_length(F.col(f), n, PAD, pad_side)).alias(f"{names[f]}_ids"))
        out.append(F.when(present, A.attention_mask(F.col(f), n, pad_side)).alias(f"{names[f]}_mask"))
    return by_field.select(*ids, *out)
