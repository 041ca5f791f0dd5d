"""Perplexity of fixed texts kept up while a count model is trained.

The perplexity of a split is exp of a weighted sum of token losses, and the losses of a count model are differences of logarithms of
counts. So the sum falls apart into terms by context, by pair and by token, and a training step changes only the terms whose count
it raises. What no step can touch term by term, the size of the model, is one number times the weight of the unseen pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators.ngrams import BACKOFF, bigram_rows
from tidemark.operators.ordinals import batch_of
from tidemark.operators.skew import fits_broadcast
from tidemark.session import discard, exists, materialize, short_shuffles
from tidemark.sources.tables import metric_rows

COUNTS = "kind string, prev string, token string, n long, step int"
WORDS = "token string, step int"
TOTALS = "split string, value double, unseen double, n_tokens long, n_words long, step int"


def batch_sizes(texts: DataFrame, position: str, batch_size: int, text: str = "text", split: str = "split") -> DataFrame:
    """``split, batch_id, weight``: what a token of each batch weighs, one over the tokens of its batch and the batches of its split.

    Tokens are counted inside the text; batches without tokens weigh nothing and are left out.
    """
    counted = texts.select(F.col(split).alias("split"), batch_of(F.col(position), batch_size).alias("batch_id"),
                           F.regexp_count(text, F.lit(T.TOKEN)).cast("long").alias("n"))
    batches = materialize(counted.groupBy("split", "batch_id").agg(F.sum("n").alias("n")).filter("n > 0"), "batch-sizes")
    splits = batches.groupBy(F.col("split").alias("_s")).agg(F.count("*").alias("batches"))
    met = batches.join(F.broadcast(splits), F.col("split").eqNullSafe(F.col("_s")))
    return met.select("split", "batch_id", (1 / (F.col("n") * F.col("batches"))).alias("weight"))


def weighted_texts(
    texts: DataFrame, sizes: DataFrame, position: str, batch_size: int, text: str = "text", split: str = "split"
) -> DataFrame:
    """``split, weight`` and ``_text`` of every text that holds tokens, with the weight of each of them from :func:`batch_sizes`."""
    placed = texts.select(F.col(split).alias("split"), batch_of(F.col(position), batch_size).alias("batch_id"), F.col(text).alias("_text"))
    sizes = sizes.select(F.col("split").alias("_split"), F.col("batch_id").alias("_batch"), "weight")
    if fits_broadcast(sizes):
        sizes = F.broadcast(sizes)
    return placed.join(sizes, F.col("split").eqNullSafe(F.col("_split")) & (F.col("batch_id") == F.col("_batch"))).select("split", "weight", "_text")


def weighted_tokens(
    texts: DataFrame, sizes: DataFrame, position: str, batch_size: int, text: str = "text", split: str = "split"
) -> DataFrame:
    """``split, weight, pos, prev, token`` of every token, with the weights of :func:`batch_sizes`."""
    return bigram_rows(weighted_texts(texts, sizes, position, batch_size, text, split), ["split", "weight"], "_text")


def split_weights(sizes: DataFrame) -> tuple[list, list[Column]]:
    """The splits of :func:`batch_sizes`, of which there are few, and of :func:`weighted_tokens` the weight in each, as columns ``_w0, _w1, ...``."""
    splits = [r["split"] for r in sizes.select("split").distinct().collect()]
    return splits, [F.when(F.col("split").eqNullSafe(F.lit(s)), F.col("weight")).otherwise(0.0).alias(f"_w{j}") for j, s in enumerate(splits)]


def start(texts: DataFrame, position: str, batch_size: int, folder: str, text: str = "text", split: str = "split") -> None:
    """Write down what is validated: the weight of every pair of tokens in each split, before any training.

    ``position`` counts the texts of a split from zero. A token weighs one over the tokens of its batch and the batches of its split, so
    weights add up to 1 in a split and the weighted sum of losses is the mean over batches of each batch's mean loss. Texts without
    tokens weigh nothing, a null split is a split. There are few splits; each is a column.
    """
    spark = texts.sparkSession
    sizes = batch_sizes(texts, position, batch_size, text, split)
    splits, weights = split_weights(sizes)
    names = [f"_w{j}" for j in range(len(splits))]
    sums = lambda df, *keys: df.groupBy(*keys).agg(F.count("*").alias("_rows"), *[F.sum(w).alias(w) for w in names]).drop("_rows")
    weighted = weighted_tokens(texts, sizes, position, batch_size, text, split)
    with short_shuffles(spark):
        sums(weighted.select("prev", "token", *weights), "prev", "token").write.mode("overwrite").parquet(f"{folder}/pairs")
    numbered = spark.createDataFrame(list(enumerate(splits)), "no int, split string")
    numbered.coalesce(1).write.mode("overwrite").parquet(f"{folder}/splits")
    pairs = spark.read.schema(_weights(names, "prev string, token string")).parquet(f"{folder}/pairs")
    # Step 0 names every context and every token that is validated.
    sums(pairs, "token").write.mode("overwrite").parquet(f"{folder}/unseen/step=0")
    contexts = pairs.select("prev").distinct().select("prev", *[F.lit(0.0).alias(w) for w in names])
    contexts.write.mode("overwrite").parquet(f"{folder}/seen/step=0")
    _empty(spark, "kind string, prev string, token string, n long").write.mode("overwrite").parquet(f"{folder}/counts/step=0")
    _empty(spark, "token string").write.mode("overwrite").parquet(f"{folder}/words/step=0")
    unseen = pairs.agg(*[F.sum(w).alias(w) for w in names]) if names else pairs.limit(0)
    none = F.lit(0).cast("long")
    totals = _by_split(unseen, {"unseen": names}, splits).select(
        "split", F.lit(0.0).alias("value"), "unseen", none.alias("n_tokens"), none.alias("n_words"))
    totals.write.mode("overwrite").parquet(f"{folder}/totals/step=0")


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _weights(names: list[str], keys: str) -> str:
    return ", ".join([keys, *[f"{w} double" for w in names]])


def _by_split(one: DataFrame, values: dict[str, list[str]], splits: list) -> DataFrame:
    """``split`` and ``values`` by name, a row per split, from a row with a column for each split."""
    rows = [F.struct(F.lit(s).cast("string").alias("split"), *[F.col(names[j]).alias(v) for v, names in values.items()])
            for j, s in enumerate(splits)]
    if not rows:
        return one.select(F.lit("").alias("split"), *[F.lit(0.0).alias(v) for v in values]).limit(0)
    return one.select(F.explode(F.array(*rows)).alias("_s")).select("_s.*")


def _read(spark: SparkSession, folder: str, name: str, schema: str, before: int) -> DataFrame:
    """Rows of a table of the folder that steps before ``before`` wrote; files of later steps are not opened."""
    return spark.read.schema(schema).parquet(f"{folder}/{name}").filter(F.col("step") < before)


def advance(spark: SparkSession, folder: str, step: int, counts: DataFrame) -> DataFrame:
    """``split, step, loss, ppl`` after training step ``step`` (from 1, in order), which adds ``counts`` (``prev, token, n``) to the model.

    The step's counts meet the validated pairs in one join, where the counts are made; contexts and tokens follow from that, each in one
    aggregation with what is known of them. Only what changed is written. Everything
    follows from the steps before, so a step that is run again overwrites its own rows with the same. A step without counts
    changes nothing. Raises ``ValueError`` when the step before has not been taken.
    """
    if step < 1 or not exists(spark, f"{folder}/totals/step={step - 1}"):
        raise ValueError(f"step {step} needs step {step - 1} first")
    splits = [r["split"] for r in spark.read.parquet(f"{folder}/splits").orderBy("no").collect()]
    names = [f"_w{j}" for j in range(len(splits))]
    moves = [f"_m{j}" for j in range(len(splits))]  # weight of the pairs that the step sees first
    earlier = _read(spark, folder, "counts", COUNTS, step)
    ln = lambda n: F.when(n > 0, F.log(n)).otherwise(0.0)
    n0, n1 = F.col("_n0"), F.col("_n0") + F.col("n")

    # Counts, validated pairs and earlier counts of pairs have one row per pair each.
    counts = counts.groupBy("prev", "token").agg(F.sum("n").cast("long").alias("n"))
    pairs = spark.read.schema(_weights(names, "prev string, token string")).parquet(f"{folder}/pairs")
    known = pairs.withColumn("_known", F.lit(True))
    if step > 1:
        before = earlier.filter("kind = 'pair'").groupBy("prev", "token").agg(F.sum("n").alias("_n0"))
        met = counts.join(known, ["prev", "token"], "left").join(before, ["prev", "token"], "left")
    else:
        met = counts.join(known, ["prev", "token"], "left").withColumn("_n0", F.lit(0).cast("long"))
    met = materialize(met.withColumn("_n0", F.coalesce("_n0", F.lit(0).cast("long"))), "step-pairs")
    raised = met.filter("_known")
    first = F.col("_known") & (n0 == 0)

    def ends(key: str, kind: str, name: str, extra: DataFrame | None = None) -> DataFrame:
        """Each ``key`` of the step: counts, weights before it and moved by it, whether it is validated, whether an earlier step had it."""
        zero, no = F.lit(0).cast("long"), F.lit(0)
        def rows(df, n=zero, n0=zero, w=None, m=None, now=no, known=no, had=no):  # noqa: E306
            return df.select(
                key, n.alias("n"), n0.alias("_n0"), *[(F.col(x) if w else F.lit(0.0)).alias(x) for x in names],
                *[(m(F.col(x)) if m else F.lit(0.0)).alias(y) for x, y in zip(names, moves)],
                now.alias("_now"), known.alias("_known"), had.alias("_had"))

        parts = [rows(met, n=F.col("n"), m=lambda w: F.when(first, w).otherwise(0.0), now=F.lit(1)),
                 rows(earlier.filter(F.col("kind") == kind), n0=F.col("n")),
                 rows(_read(spark, folder, name, _weights(names, f"{key} string") + ", step int", step), w=True,
                      known=(F.col("step") == 0).cast("int"))]
        if extra is not None:
            parts.append(rows(extra, had=F.lit(1)))
        found = reduce(DataFrame.unionByName, parts).groupBy(key).agg(
            *[F.sum(c).alias(c) for c in ("n", "_n0", *names, *moves)], *[F.max(c).alias(c) for c in ("_now", "_known", "_had")])
        return materialize(found.filter("_now = 1").drop("_now"), f"step-{kind}s")

    contexts = ends("prev", "context", "seen")
    tokens = ends("token", "token", "unseen", _read(spark, folder, "words", WORDS, step))

    # What of the step the validated texts know, by kind of count.
    none = F.lit(None).cast("string")
    raised.select(F.lit("pair").alias("kind"), "prev", "token", "n").unionByName(
        contexts.filter("_known = 1").select(F.lit("context").alias("kind"), "prev", none.alias("token"), "n")).unionByName(
        tokens.filter("_known = 1").select(F.lit("token").alias("kind"), none.alias("prev"), "token", "n")
    ).write.mode("overwrite").parquet(f"{folder}/counts/step={step}")
    # Pairs seen for the first time: their weight goes from their token to their context.
    moved = reduce(lambda a, b: a | b, [F.col(m) != 0 for m in moves], F.lit(False))
    contexts.filter(moved).select("prev", *[F.col(m).alias(w) for w, m in zip(names, moves)]).write.mode("overwrite").parquet(f"{folder}/seen/step={step}")
    tokens.filter(moved).select("token", *[(-F.col(m)).alias(w) for w, m in zip(names, moves)]).write.mode("overwrite").parquet(f"{folder}/unseen/step={step}")
    tokens.filter("_had = 0").select("token").write.mode("overwrite").parquet(f"{folder}/words/step={step}")

    # Terms by pair, context and token, and the weight that moves.
    w, m = [F.col(x) for x in names], [F.col(x) for x in moves]
    zeros = [F.lit(0.0).alias(x) for x in moves]
    terms = raised.select(*[(-x * (ln(n1) - ln(n0))).alias(c) for x, c in zip(w, names)], *zeros).unionByName(
        contexts.filter("_known = 1").select(*[((x + y) * ln(n1) - x * ln(n0)).alias(c) for x, y, c in zip(w, m, names)], *zeros)).unionByName(
        tokens.filter("_known = 1").select(
            *[(x * F.log(n0 + 1) - (x - y) * F.log(n1 + 1)).alias(c) for x, y, c in zip(w, m, names)], *moves))
    changes = terms.agg(F.count("*").alias("_rows"), *[F.coalesce(F.sum(x), F.lit(0.0)).alias(x) for x in (*names, *moves)])
    changes = _by_split(changes, {"_change": names, "_moved": moves}, splits).withColumnRenamed("split", "_split")

    # The size of the model: tokens, and different tokens.
    size = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("more"), F.count(F.when(F.col("_had") == 0, 1)).alias("words")).first()
    totals = _read(spark, folder, "totals", TOTALS, step).filter(F.col("step") == step - 1).drop("step")
    totals = totals.join(F.broadcast(changes), F.col("split").eqNullSafe(F.col("_split"))).select(  # a row per split
        "split", (F.col("value") + F.col("_change")).alias("value"), (F.col("unseen") - F.col("_moved")).alias("unseen"),
        (F.col("n_tokens") + size["more"]).alias("n_tokens"), (F.col("n_words") + size["words"]).alias("n_words"))
    totals.write.mode("overwrite").parquet(f"{folder}/totals/step={step}")
    for table in (met, contexts, tokens):
        discard(table)
    return validation(spark, folder).filter(F.col("step") == step)


def validation(spark: SparkSession, folder: str, backoff: float = BACKOFF) -> DataFrame:
    """``split, step, loss, ppl`` after every step taken so far; step 0 is the untrained model."""
    totals = spark.read.schema(TOTALS).parquet(f"{folder}/totals")
    size = F.log(F.col("n_tokens") + F.col("n_words") + 1) - F.log(F.lit(backoff))
    return totals.select("split", "step", (F.col("value") + F.col("unseen") * size).alias("loss")).withColumn("ppl", F.exp("loss"))


def validation_metrics(found: DataFrame, run_id: str) -> DataFrame:
    """Rows of the metric log (``log_metrics``) for what :func:`advance` or :func:`validation` returns."""
    return metric_rows(found, F.lit(run_id), F.col("split"), F.col("step"), ["loss", "ppl"])
