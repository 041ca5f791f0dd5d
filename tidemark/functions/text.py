"""Text expressions. Every function maps a Column to a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks and rules that scores depend on.
SPECIAL_MARKS = ["<pad>", "</s>"]
DROPPED_MARKS = ".,'\""
ASCII_PUNCTUATION = r"[!-/:-@\[-`{-~]"
ARTICLES = r"(?U)\b(a|an|the)\b"
BLANKS = r"(?U)[\s\x1c-\x1f]+"
DETOKENIZE_PAIRS = [(" n't", "n't"), (" )", ")"), ("( ", "("), ('" ', '"'), (' "', '"')]
DETOKENIZE_PATTERN = r" (['.,])"

# A token is a run of letters and digits, or one other visible character.
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
# A word is a run without blanks, together with the blanks behind it.
WORD_WITH_BLANKS = r"[^ ]+ *"
SENTENCE = r"[^.!?\n]+[.!?]*"


def drop_marks(text: Column) -> Column:
    """Remove padding and end marks, then full stops, commas and quotes."""
    for mark in SPECIAL_MARKS:
        text = F.replace(text, F.lit(mark), F.lit(""))
    return F.translate(text, DROPPED_MARKS, "")


def first_sentence(text: Column) -> Column:
    """Text up to and including the first full stop; unchanged without one."""
    stop = F.instr(text, ".")
    return F.when(stop > 0, F.substring(text, F.lit(1), stop)).otherwise(text)


def normalize_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no English articles, single blanks."""
    bare = F.regexp_replace(F.lower(text), ASCII_PUNCTUATION, "")
    return F.btrim(F.regexp_replace(F.regexp_replace(bare, ARTICLES, " "), BLANKS, " "))


def strip_blanks(text: Column) -> Column:
    """Remove every kind of blank at both ends (``trim`` removes spaces only)."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def answer_tokens(text: Column) -> Column:
    """Words of the normalised answer; empty text gives an empty array."""
    return F.filter(F.split(normalize_answer(text), " "), lambda w: w != "")


def detokenize(text: Column) -> Column:
    """Join English contractions, brackets, quotes and stops to their words."""
    for spaced, joined in DETOKENIZE_PAIRS:
        text = F.replace(text, F.lit(spaced), F.lit(joined))
    return F.regexp_replace(text, DETOKENIZE_PATTERN, "$1")


def argument_list(args: Column) -> Column:
    """``k=v,k=v`` as an array of ``[k, v]`` arrays; blank text gives an empty array."""
    text = strip_blanks(args)
    return F.when(text == "", F.array().cast("array<array<string>>")).otherwise(
        F.transform(F.split(text, ","), lambda pair: F.split(pair, "="))
    )


def arguments_are_valid(args: Column) -> Column:
    """True when every pair has exactly one equals sign."""
    return F.forall(argument_list(args), lambda pair: F.size(pair) == 2)


def parse_arguments(args: Column) -> Column:
    """Map of the pairs; a repeated key keeps its last value."""
    pairs = argument_list(args)
    last = F.filter(
        pairs,
        lambda pair, i: ~F.exists(
            F.slice(pairs, i + 2, F.size(pairs)), lambda later: later[0] == pair[0]
        ),
    )
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p[0].alias("key"), p[1].alias("value"))))


def tokens(text: Column) -> Column:
    """Tokens of a text in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def sentences(text: Column) -> Column:
    """Trimmed, non-empty sentences in order."""
    found = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != "")


def word_pieces(text: Column, pieces=tokens) -> Column:
    """One struct per token: ``word_pos``, ``first``, ``span``, ``word``, ``token``.

    ``span`` is the number of tokens of the word. Every blank beyond the separating one costs one
    token (``token`` is a single blank, ``word`` is null), and so does every blank behind the last word; blanks
    before the first word cost nothing.
    """
    # One more blank at the end, so that the last word has its separating blank too.
    found = F.regexp_extract_all(F.concat(text, F.lit(" ")), F.lit(WORD_WITH_BLANKS), F.lit(0))

    def take_apart(chunk, position):
        word = F.rtrim(chunk)
        return F.struct(
            position.cast("int").alias("at"), word.alias("word"), pieces(word).alias("parts"),
            F.greatest(F.length(chunk) - F.length(word) - 1, F.lit(0)).alias("extra"),
        )

    def expand(w):
        own = F.transform(
            w["parts"],
            lambda part, i: F.struct(
                w["at"].alias("word_pos"), (i == 0).alias("first"), F.size(w["parts"]).alias("span"),
                w["word"].alias("word"), part.alias("token"),
            ),
        )
        blank = F.struct(
            w["at"].alias("word_pos"), F.lit(False).alias("first"), F.lit(0).alias("span"),
            F.lit(None).cast("string").alias("word"), F.lit(" ").alias("token"),
        )
        # Few words have extra blanks; the others need no second array.
        return F.when(w["extra"] > 0, F.concat(own, F.array_repeat(blank, w["extra"]))).otherwise(own)

    return F.flatten(F.transform(F.transform(found, take_apart), expand))


def word_starts(text: Column) -> Column:
    """An element for every token that :func:`word_pieces` gives: ``word_pos, word, span`` of a word at its first token, null at all others."""
    found = F.regexp_extract_all(F.concat(text, F.lit(" ")), F.lit(WORD_WITH_BLANKS), F.lit(0))
    kind = "struct<word_pos:int,word:string,span:int,extra:int>"

    def take_apart(chunk, position):
        word = F.rtrim(chunk)
        return F.struct(
            position.cast("int").alias("word_pos"), word.alias("word"), F.regexp_count(word, F.lit(TOKEN)).alias("span"),
            F.greatest(F.length(chunk) - F.length(word) - 1, F.lit(0)).alias("extra"),
        )

    def spread(w):
        first = F.when(w["span"] > 0, F.array(w)).otherwise(F.array().cast(f"array<{kind}>"))
        others = F.array_repeat(F.lit(None).cast(kind), F.greatest(w["span"], F.lit(1)) - 1 + w["extra"])
        return F.when((w["span"] == 1) & (w["extra"] == 0), F.array(w)).otherwise(F.concat(first, others))

    return F.flatten(F.transform(F.transform(found, take_apart), spread))
