"""Models that follow a corpus over time, and the grid that compares them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ngrams, validation
from tidemark.operators.ordinals import with_position
from tidemark.operators.sampling import replay_mix
from tidemark.session import discard, materialize


def initial(prev: DataFrame) -> DataFrame:
    """Train on the earlier snapshot."""
    return ngrams.train(prev)


def brute_force(curr: DataFrame) -> DataFrame:
    """Train on the whole later snapshot."""
    return ngrams.train(curr)


def subset(model: DataFrame, diff: DataFrame) -> DataFrame:
    """Go on with the diff only."""
    return ngrams.merge(model, ngrams.train(diff))


def mix_review(model: DataFrame, diff: DataFrame, old: DataFrame, ids: list[str], **mix) -> DataFrame:
    """Go on with the diff and a sample of the earlier snapshot."""
    return ngrams.merge(model, ngrams.train(replay_mix(diff, old, ids, **mix)))


def perplexity_grid(
    corpora: list[tuple[DataFrame, list[str]]], texts: DataFrame, example: str, batch_size: int, split: str = "split"
) -> DataFrame:
    """``method, split, ppl`` of count models on every split of ``texts``.

    ``corpora`` has tables of texts, each with the methods whose models learn from it. Equal texts, learnt or validated, become one row that knows
    how often each method learns from it and what its tokens weigh in each split, and this table is written down. All pairs of tokens are
    counted in one pass over it with a column for each method and each split (of which there are few), so the models and the tokens are
    never written down, and nothing else is read later. The loss falls apart into terms by pair, context and token as in :mod:`tidemark.operators.validation`.
    """
    methods = list(dict.fromkeys(m for _, names in corpora for m in names))
    placed = with_position(texts.select(split, example, "text"), [example], [split])
    sizes = validation.batch_sizes(placed, "position", batch_size, split=split)
    splits, weights = validation.split_weights(sizes)
    if not splits:
        return texts.select(F.lit("").alias("method"), split, F.lit(0.0).alias("ppl")).limit(0)
    ns, ws = [f"_n{i}" for i in range(len(methods))], [f"_w{j}" for j in range(len(splits))]
    rows = validation.weighted_texts(placed, sizes, "position", batch_size, split=split).select(
        "_text", *[F.lit(0).alias(n) for n in ns], *weights)
    for corpus, names in corpora:
        rows = rows.unionByName(corpus.select(
            F.col("text").alias("_text"), *[F.lit(int(m in names)).alias(n) for m, n in zip(methods, ns)], *[F.lit(0.0).alias(w) for w in ws]))
    once = materialize(rows.groupBy("_text").agg(*[F.sum(c).alias(c) for c in (*ns, *ws)]), "grid-texts")
    discard(placed)
    pair = F.concat_ws(" ", "prev", "token").alias("_pair")  # no token holds a blank
    pairs = ngrams.bigram_rows(ngrams.dealt(once, "_text", ngrams.TASK_TEXT, [*ns, *ws]), [*ns, *ws], "_text").select(pair, *ns, *ws)
    pairs = pairs.groupBy("_pair").agg(*[F.sum(c).alias(c) for c in (*ns, *ws)])

    # A seen pair weighs at its context, an unseen one at its token. Every pair is one row for either.
    ends = F.array(F.struct(F.lit(True).alias("_context"), F.substring_index("_pair", " ", 1).alias("_key")),
                   F.struct(F.lit(False).alias("_context"), F.substring_index("_pair", " ", -1).alias("_key")))
    ends = pairs.select(F.explode(ends).alias("_end"), *ns, *ws).select("_end.*", *ns, *ws)
    grid = [(n, w, f"{n}{w}") for n in ns for w in ws]
    here = lambda n: F.col("_context") == (F.col(n) > 0)
    sums = ends.groupBy("_context", "_key").agg(
        *[F.sum(n).alias(n) for n in ns],
        *[F.sum(F.when(here(n), F.col(w)).otherwise(0.0)).alias(x) for n, w, x in grid],
        *[F.sum(F.when(F.col("_context") & (F.col(n) > 0), F.col(w) * F.log(n)).otherwise(0.0)).alias(f"{x}_pairs") for n, w, x in grid])
    term = lambda n, x: F.when(~F.col("_context"), -F.col(x) * F.log(F.col(n) + 1)).otherwise(
        F.when(F.col(n) > 0, F.col(x) * F.log(n)).otherwise(0.0) - F.col(f"{x}_pairs"))
    of_token = lambda value: F.sum(F.when(F.col("_context"), 0).otherwise(value))
    found = sums.agg(
        *[F.sum(term(n, x)).alias(x) for n, _, x in grid], *[of_token(F.col(x)).alias(f"{x}_unseen") for _, _, x in grid],
        *[F.log(of_token(F.col(n) + (F.col(n) > 0).cast("int")) + 1).alias(n) for n in ns])
    kind = texts.schema[split].dataType
    losses = [F.struct(F.lit(m).alias("method"), F.lit(s).cast(kind).alias(split),
                       (F.col(f"{n}{w}") + F.col(f"{n}{w}_unseen") * (F.col(n) - F.log(F.lit(ngrams.BACKOFF)))).alias("loss"))
              for m, n in zip(methods, ns) for s, w in zip(splits, ws)]
    found = found.select(F.explode(F.array(*losses)).alias("_l"))
    return found.select("_l.method", f"_l.{split}", F.exp("_l.loss").alias("ppl"))
