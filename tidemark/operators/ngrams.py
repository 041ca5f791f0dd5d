"""N-gram count models: train, merge, score and complete.

A model is a table ``prev, token, n`` of bigram counts; every text begins behind a start token, so each
token is counted exactly once and all other counts follow from this table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators.ordinals import batch_of
from tidemark.operators.skew import BROADCAST_ROWS, fits_broadcast, heavy_hitters, lookup_join, rows_of
from tidemark.session import discard, materialize
from tidemark.sources.tables import write_bucketed

START = "<s>"
TASK_TEXT = 16 * 1024 * 1024  # bytes of text whose pairs one task counts
BACKOFF = 0.4  # weight of the single-token estimate for an unseen pair


def bigram_rows(rows: DataFrame, ids: list[str], text: str = "text", length: int | None = None) -> DataFrame:
    """``ids, pos, prev, token`` for every token, or for the first ``length`` tokens of fixed-length sequences."""
    tokens = T.tokens(F.col(text))
    split = rows.select(*ids, (F.slice(tokens, 1, length) if length else tokens).alias("_tokens"))
    shifted = F.concat(F.array(F.lit(START)), F.col("_tokens")).alias("prev")
    pairs = F.arrays_zip(shifted, F.col("_tokens").alias("token"))
    flat = split.select(*ids, F.posexplode(pairs).alias("pos", "_p"))
    return flat.select(*ids, "pos", F.col("_p.prev").alias("prev"), F.col("_p.token").alias("token")).filter(
        "token is not null"
    )


def dealt(corpus: DataFrame, text: str, size: int, others: list[str] = ()) -> DataFrame:
    """The texts, alone or with ``others``, dealt over tasks of about ``size`` bytes where there are more of these than cores.

    Most pairs are rare, so a task counts about as many different ones as its texts hold. Beyond its memory Spark sorts and spills them, which
    costs more than to move the texts once.
    """
    corpus = corpus.select(text, *others)
    found = corpus.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    pieces = -(-found // size)
    return corpus.repartition(pieces) if pieces > corpus.sparkSession.sparkContext.defaultParallelism else corpus


def train(corpus: DataFrame, text: str = "text", length: int | None = None) -> DataFrame:
    """Bigram counts of a corpus."""
    corpus = dealt(corpus, text, TASK_TEXT)
    return bigram_rows(corpus, [], text, length).groupBy("prev", "token").agg(F.count("*").alias("n"))


def merge(*models: DataFrame) -> DataFrame:
    """Counts of several models together; training on more text is merging its counts."""
    union = models[0]
    for model in models[1:]:
        union = union.unionByName(model)
    return union.groupBy("prev", "token").agg(F.sum("n").alias("n"))


@dataclass
class Scorer:
    """Loss tables of a model, written down once: pairs, single tokens, and the loss of an unknown token."""

    pairs: DataFrame
    singles: DataFrame
    unknown: DataFrame


def scorer(model: DataFrame, backoff: float = BACKOFF, broadcast_rows: int = BROADCAST_ROWS) -> Scorer:
    """Turn counts to losses.

    A seen pair costs ``-ln(n(prev, token) / n(prev))``. An unseen one costs
    ``-ln(backoff * (n(token) + 1) / (N + V + 1))`` with N tokens and V different ones in the model.
    """
    model = materialize(model, "bigrams")
    contexts = model.groupBy("prev").agg(F.sum("n").alias("n_prev"))
    singles = materialize(model.groupBy("token").agg(F.sum("n").alias("n")), "unigrams")
    # ln of the denominator as a one-row table, read as a scalar where needed
    size = singles.agg(F.log(F.coalesce(F.sum("n"), F.lit(0)) + F.count("*") + 1).alias("ln_size"))
    weight = F.log(F.lit(backoff))
    pairs = lookup_join(model, materialize(contexts, "contexts"), ["prev"], broadcast_rows=broadcast_rows)
    pairs = materialize(pairs.select("prev", "token", "n", (F.log("n_prev") - F.log("n")).alias("pair_nll")), "pair-losses")
    discard(model)  # the losses hold them too
    return Scorer(
        pairs,
        materialize(
            singles.select("token", "n", (size.scalar() - F.log(F.col("n") + 1) - weight).alias("single_nll")),
            "token-losses",
        ),
        size.select((F.col("ln_size") - weight).alias("unknown_nll")),
    )


def save_scorer(model: Scorer, name: str, path: str, buckets: int) -> Scorer:
    """Keep loss tables bucketed by their keys, for a model that scores many texts: only the texts are shuffled then."""
    return Scorer(
        write_bucketed(model.pairs, f"{name}_pairs", f"{path}/pairs", ["prev", "token"], buckets),
        write_bucketed(model.singles, f"{name}_tokens", f"{path}/tokens", ["token"], buckets),
        materialize(model.unknown, "unknown-loss"),
    )


def score_tokens(
    rows: DataFrame, model: Scorer, sample: DataFrame | None = None, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Add ``nll`` to rows with ``prev, token``.

    Small loss tables are broadcast. Beyond that the rows are written down once; frequent pairs and tokens, known to the model or
    not, come from sketches over what was written (or from a ``sample`` of the rows) and meet the rows by broadcast. Only rows with
    other pairs are shuffled by pair, and only those that are still without a loss by token.
    """
    pairs, singles = model.pairs.select("prev", "token", "pair_nll"), model.singles.select("token", "single_nll")
    unknown = model.unknown.scalar()
    if fits_broadcast(pairs, broadcast_rows) and fits_broadcast(singles, broadcast_rows):
        known = rows.join(F.broadcast(pairs), ["prev", "token"], "left").join(F.broadcast(singles), ["token"], "left")
        return known.withColumn("nll", F.coalesce("pair_nll", "single_nll", unknown)).drop("pair_nll", "single_nll")

    rows = materialize(rows, "tokens")
    counted = rows if sample is None else materialize(sample.select("prev", "token"), "sample")
    hot_pairs = materialize(heavy_hitters(counted, ["prev", "token"]), "heavy-pairs")
    hot_tokens = materialize(heavy_hitters(counted, ["token"]), "heavy-tokens")
    pair_losses = materialize(rows_of(hot_pairs, pairs, ["prev", "token"]), "hot-pairs")
    token_losses = materialize(rows_of(hot_tokens, singles, ["token"]).withColumnRenamed("single_nll", "_token_nll"), "hot-tokens")

    hashed = rows.withColumn("_hash", F.xxhash64("prev", "token"))
    quick = hashed.join(F.broadcast(hot_pairs), "_hash", "left_semi").drop("_hash").join(F.broadcast(pair_losses), ["prev", "token"], "left")
    rest = hashed.join(F.broadcast(hot_pairs), "_hash", "left_anti").drop("_hash").join(pairs, ["prev", "token"], "left")
    known = quick.unionByName(rest).join(F.broadcast(token_losses), ["token"], "left").withColumn("_hash", F.xxhash64("token"))
    known = known.join(F.broadcast(hot_tokens.withColumn("_frequent", F.lit(True))), "_hash", "left")
    # A frequent token that the model lacks is as unknown as it will be.
    known = known.withColumn("nll", F.coalesce("pair_nll", "_token_nll", F.when(F.col("_frequent"), unknown)))
    known = known.drop("pair_nll", "_token_nll", "_frequent", "_hash")
    done = known.filter(F.col("nll").isNotNull())
    rare = known.filter(F.col("nll").isNull()).drop("nll").join(singles, ["token"], "left")
    return done.unionByName(rare.withColumn("nll", F.coalesce("single_nll", unknown)).drop("single_nll"))


def score_corpus(
    corpus: DataFrame, position: str, model: Scorer, batch_size: int, text: str = "text", by: list[str] = (),
    length: int | None = None, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Token losses of every text with the batch its text falls in.

    ``position`` counts the texts from zero, within ``by`` when given; the batch follows without a shuffle.
    """
    ids = [*by, "batch_id", position]
    placed = corpus.withColumn("batch_id", batch_of(F.col(position), batch_size)).select(*ids, text)
    return score_tokens(bigram_rows(placed, ids, text, length), model, broadcast_rows=broadcast_rows)


def weighted_loss(weighted: DataFrame, model: Scorer, weights: list[str]) -> DataFrame:
    """One row: for each of ``weights`` the sum of weight times loss over ``weighted``, which has a row per pair (``prev, token``).

    A pair meets the losses of pairs once, however many tokens it stands for. The loss of an unseen pair is that of its token, so the weights
    of unseen pairs are added up by token, in tasks first, before they meet the losses of tokens.
    """
    seen = F.col("pair_nll").isNotNull()
    found = weighted.join(model.pairs.select("prev", "token", "pair_nll"), ["prev", "token"], "left").groupBy("token").agg(
        *[F.sum(F.when(seen, F.col(w) * F.col("pair_nll")).otherwise(0.0)).alias(f"_seen_{w}") for w in weights],
        *[F.sum(F.when(seen, 0.0).otherwise(F.col(w))).alias(f"_unseen_{w}") for w in weights])
    found = found.join(model.singles.select("token", "single_nll"), "token", "left")  # a row per token on both sides
    nll = F.coalesce("single_nll", model.unknown.scalar())
    return found.agg(*[F.sum(F.col(f"_seen_{w}") + F.col(f"_unseen_{w}") * nll).alias(w) for w in weights])


def continuations(model: Scorer, top: int) -> DataFrame:
    """The ``top`` best next tokens of every context: ``prev, token, pair_nll``.

    The filter on the rank lets Spark keep only ``top`` rows per context in each task before the shuffle,
    so a context with very many pairs does not gather in one task.
    """
    rank = F.row_number().over(W.partitionBy("prev").orderBy("pair_nll", "token"))
    return model.pairs.select("prev", "token", "pair_nll").withColumn("_rank", rank).filter(F.col("_rank") <= top).drop("_rank")


def complete(
    prompts: DataFrame, ids: list[str], model: Scorer, steps: int, beams: int = 2, prompt: str = "input",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``ids, rank, completion, nll``: the best ``beams`` completions of up to ``steps`` tokens.

    Only the last token of a prompt matters to a bigram model, so the search runs once per different last
    token and its result is looked up by the prompts. A full stop, or a token without a known continuation,
    ends a beam.
    """
    last = F.coalesce(F.try_element_at(T.tokens(F.col(prompt)), F.lit(-1)), F.lit(START))
    asked = prompts.select(*ids, last.alias("_last"))
    options = continuations(model, beams).groupBy("prev").agg(F.collect_list(F.struct("token", "pair_nll")).alias("_next"))
    options = materialize(options.withColumnRenamed("prev", "_tail"), "continuations")  # at most ``beams`` a context
    state = asked.select("_last").distinct().select(
        "_last", F.col("_last").alias("_tail"), F.array().cast("array<string>").alias("_path"),
        F.lit(0.0).alias("nll"), F.lit(False).alias("_done"),
    )
    small = fits_broadcast(options, broadcast_rows)
    # Rounded, so that two orders of adding the same losses still tie.
    best_first = W.partitionBy("_last").orderBy(F.round("nll", 9), "_text")
    for _ in range(steps):
        # A finished beam has no key and stays as it is.
        asking = state.withColumn("_tail", F.when(~F.col("_done"), F.col("_tail")))
        if small:
            found = asking.join(F.broadcast(options), "_tail", "left")
        else:
            # Many beams end in the same frequent token, hence a lookup and not a plain join. It reads the
            # state twice, so each state is written down.
            found = lookup_join(materialize(asking, "beams"), options, ["_tail"], broadcast_rows=broadcast_rows)
        grown = found.select("_last", "_path", "nll", F.explode_outer("_next").alias("_n")).select("_last", "_path", "nll", "_n.*")
        state = (
            grown.select(
                "_last",
                F.col("token").alias("_tail"),
                F.when(F.col("token").isNull(), F.col("_path")).otherwise(F.concat("_path", F.array("token"))).alias("_path"),
                (F.col("nll") + F.coalesce("pair_nll", F.lit(0.0))).alias("nll"),
                (F.col("token").isNull() | (F.col("token") == ".")).alias("_done"),
            )
            .withColumn("_text", F.array_join("_path", " "))
            .withColumn("_rank", F.row_number().over(best_first))
            .filter(F.col("_rank") <= beams)
            .drop("_rank", "_text")
        )
    best = state.select("_last", F.array_join("_path", " ").alias("completion"), "nll")
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("_last").orderBy(F.round("nll", 9), "completion")))
    # One row per last token, so that the lookup holds when one of them ends most prompts.
    listed = best.groupBy("_last").agg(F.sort_array(F.collect_list(F.struct("rank", "completion", "nll"))).alias("_best"))
    found = lookup_join(asked, materialize(listed, "completions"), ["_last"], broadcast_rows=broadcast_rows)
    return found.select(*ids, F.explode("_best").alias("_b")).select(*ids, "_b.rank", "_b.completion", "_b.nll")
