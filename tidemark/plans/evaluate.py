"""Whole evaluations, from facts or texts to result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.predicates import WORD_CLASSES, word_class
from tidemark.operators import ngrams, perplexity, prompts, scores, wordclass
from tidemark.operators.ordinals import batch_of, with_position
from tidemark.operators.skew import fits_broadcast
from tidemark.session import materialize


def answer_scores(probes: DataFrame, predictions: DataFrame, keys: list[str], by: list[str] = ()) -> DataFrame:
    """Ask for the object of each probe and score the first sentence of the answer.

    ``predictions`` has ``keys`` and ``prediction``. Answers are short, so after the one join by key
    everything happens inside the row.
    """
    asked, _ = prompts.complete_facts(probes)
    asked = prompts.fact_prompts(asked, "evaluate")
    pairs = scores.match_predictions(predictions, asked, keys)
    pairs = pairs.withColumn("prediction", T.first_sentence(F.col("prediction")))
    return scores.summarize(scores.score_short_answers(pairs), by)


def probe_losses(probes: DataFrame, order: list[str], model: ngrams.Scorer, batch_size: int, split: str | None = None) -> DataFrame:
    """Token losses of whole facts with their batch, in ``order`` within ``split``."""
    by = [split] if split else []
    whole = prompts.fact_prompts(probes, "evaluate_ppl").select(*by, *order, "input")
    placed = with_position(whole, order, by)
    return ngrams.score_corpus(placed, "position", model, batch_size, "input", by)


def probe_perplexity(
    probes: DataFrame, order: list[str], model: ngrams.Scorer, batch_size: int, split: str | None = None
) -> DataFrame:
    """Perplexity of whole facts, per ``split`` when given."""
    return perplexity.perplexity(probe_losses(probes, order, model, batch_size, split), [split] if split else [])


def corpus_class_losses(
    corpus: DataFrame, position: str, model: ngrams.Scorer, lexicon: DataFrame, batch_size: int, text: str = "text",
    length: int | None = None,
) -> DataFrame:
    """Token losses of a corpus with batch and word class; ``position`` counts the texts from zero."""
    placed = corpus.withColumn("batch_id", batch_of(F.col(position), batch_size)).select("batch_id", position, text)
    words = lambda part: wordclass.word_bigrams(part, ["batch_id", position], text, length)
    tagged = wordclass.tag_words(words(placed), lexicon).withColumn("word_class", word_class(F.col("tag")))
    tagged = tagged.drop("word", "word_pos", "tag")
    return ngrams.score_tokens(tagged, model)


def corpus_perplexity(
    corpus: DataFrame, position: str, model: ngrams.Scorer, lexicon: DataFrame, batch_size: int, text: str = "text",
    length: int | None = None,
) -> DataFrame:
    """One row: perplexity of all tokens and of names, nouns, verbs and numbers.

    The mean over batches of a batch's mean loss is a sum of losses, each times one over the tokens of its batch and the batches, of its class. So
    a first pass counts classes by batch, a second adds up the weights of each pair of tokens, and only pairs meet the model: no token is written or shuffled.
    """
    names = ["all", *WORD_CLASSES]
    ws = [f"_w_{c}" for c in names]
    placed = corpus.withColumn("batch_id", batch_of(F.col(position), batch_size)).select("batch_id", text)
    of = lambda c: F.lit(True) if c == "all" else F.col("word_class") == c

    def tagged(part: DataFrame, ids: list[str]) -> DataFrame:
        return wordclass.tag_words(wordclass.word_bigrams(part, ids, text, length), lexicon).withColumn("word_class", word_class(F.col("tag")))

    counted = tagged(placed, ["batch_id"]).groupBy("batch_id").agg(*[F.count(F.when(of(c), 1)).alias(c) for c in names])
    counted = materialize(counted, "batch-classes")
    batches = counted.agg(*[F.count(F.when(F.col(c) > 0, 1)).alias(c) for c in names]).first()
    sizes = counted.select(
        "batch_id", *[F.when(F.col(c) > 0, 1 / (F.col(c) * F.lit(batches[c]))).otherwise(0.0).alias(w) for c, w in zip(names, ws)])
    if fits_broadcast(sizes):
        sizes = F.broadcast(sizes)
    rows = tagged(placed.join(sizes, "batch_id").select(text, *ws), ws)
    pairs = rows.groupBy("prev", "token").agg(*[F.sum(F.when(of(c), F.col(w)).otherwise(0.0)).alias(w) for c, w in zip(names, ws)])
    return ngrams.weighted_loss(pairs, model, ws).select(*[F.when(F.lit(batches[c] > 0), F.exp(w)).alias(c) for c, w in zip(names, ws)])
