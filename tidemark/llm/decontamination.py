"""Benchmark decontamination: passages of test items found in training texts, and cut out.

The items' word windows form a hash set of checked size that every task gets. Texts become numbers of the items' words (all other words are
one number that fits nothing), so a window of a text is a run of numbers: its rolling hash is looked up in the set, and the
numbers themselves are compared where it is found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import bound
from tidemark.session import materialize

WORDS = 10  # words of a window
INDEX_BYTES = 16 * 1024 * 1024  # bytes of item words that are given to every task at once; more are given in turns
SEGMENT = 10_000  # windows of an item that stay together
FOUND = "n_words bigint, spans array<struct<first:bigint,last:bigint>>, items array<string>"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Bytes of no word become blanks. All bytes beyond ASCII belong to words, so the bytes of a text split as its characters do.
_BLANKED = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_RUN = re.compile(rb"[^ ]+")
_FACTORS = np.array([pow(0xD1342543DE82EF95, k + 1, 1 << 64) for k in range(64)], np.uint64)


def item_segments(benchmark: DataFrame, words: int = WORDS) -> DataFrame:
    """``item, words`` of ``benchmark`` (``item_id, text``): runs of words that together hold every window of an item once."""
    lower = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    found = benchmark.select(F.col("item_id").cast("string").alias("item"), F.regexp_extract_all(lower, F.lit(_WORD), F.lit(0)).alias("_w"))
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("_w") - words + 1, F.lit(1)), F.lit(SEGMENT)))
    cut = found.filter(F.size("_w") > 0).select("item", "_w", starts.alias("_at"))
    return cut.select("item", F.slice("_w", F.col("_at"), SEGMENT + words - 1).alias("words"))


class _Numbers(dict):
    """Numbers of the words of items; all other words are -1."""

    def __missing__(self, word: bytes) -> int:
        return -1


class Windows:
    """Hash set of the windows of items."""

    def __init__(self, rows: list[tuple[str | None, list[str]]], words: int = WORDS):
        self.names = sorted({item for item, _ in rows if item is not None})
        place = {item: i for i, item in enumerate(self.names)}
        self.numbers = _Numbers()
        flat, found = [], {}
        for item, said in rows:
            length, at = min(words, len(said)), len(flat)
            flat += [self.numbers.setdefault(w.encode(), len(self.numbers)) for w in said]
            starts, owners = found.setdefault(length, ([], []))
            starts.append(np.arange(at, len(flat) - length + 1))
            owners.append(np.full(len(starts[-1]), place.get(item, -1)))
        self.flat = np.array(flat, np.int32)
        self.by_length = {}
        for length, (starts, owners) in found.items():
            starts, owners = np.concatenate(starts), np.concatenate(owners)
            hashes = self._hash(self.flat, starts, length)
            order = np.argsort(hashes, kind="stable")
            self.by_length[length] = hashes[order], starts[order], owners[order].astype(np.int32)

    @staticmethod
    def _hash(numbers: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        h = np.zeros(len(starts), np.uint64)
        for k in range(length):
            h += numbers[starts + k].astype(np.uint64) * _FACTORS[k % 64]
            h ^= h >> np.uint64(29)
        return h

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, lengths and items of all windows that occur in a row of numbers; windows with a -1 are passed over."""
        unknown = np.concatenate([[0], np.cumsum(numbers < 0)])
        out: list[list[np.ndarray]] = [[], [], []]
        for length, (hashes, starts, owners) in self.by_length.items():
            if len(numbers) < length:
                continue
            at = np.flatnonzero(unknown[length:] == unknown[:-length])
            h = self._hash(numbers, at, length)
            low = np.searchsorted(hashes, h)
            same = low < len(hashes)
            same[same] = hashes[low[same]] == h[same]
            at, low, h = at[same], low[same], h[same]
            many = np.searchsorted(hashes, h, "right") - low  # the same window in several items, or equal hashes
            at, low = np.repeat(at, many), np.repeat(low, many)
            low += np.arange(len(low)) - np.repeat(np.cumsum(many) - many, many)
            true = np.ones(len(at), bool)
            for k in range(length):
                true &= numbers[at + k] == self.flat[starts[low] + k]
            for column, value in zip(out, (at[true], np.full(int(true.sum()), length), owners[low[true]])):
                column.append(value)
        return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)

    def find(self, texts: list[str | None]) -> pd.DataFrame:
        """``n_words, spans, items`` of every text; spans are first and last word of each run of hit words, from 0."""
        said = [(t or "").encode().translate(_BLANKED).split() for t in texts]
        sizes = np.array([len(w) for w in said], np.int64)
        first = np.cumsum(sizes + 1) - sizes - 1  # a -1 behind every text, so that no window reaches into the next
        numbers = np.full(int((sizes + 1).sum()), -1, np.int32)
        number = self.numbers.__getitem__
        for at, words in zip(first.tolist(), said):
            numbers[at:at + len(words)] = np.fromiter(map(number, words), np.int32, len(words))
        at, length, item = self.hits(numbers)
        edges = np.zeros(len(numbers) + 1, np.int64)
        np.add.at(edges, at, 1)
        np.add.at(edges, at + length, -1)
        hit = np.concatenate([[0], (np.cumsum(edges) > 0).astype(np.int8)])
        begin, end = np.flatnonzero(np.diff(hit) > 0), np.flatnonzero(np.diff(hit) < 0)
        spans: list[list[dict]] = [[] for _ in texts]
        for row, a, b in zip((np.searchsorted(first, begin, "right") - 1).tolist(), begin.tolist(), end.tolist()):
            spans[row].append({"first": a - int(first[row]), "last": b - 1 - int(first[row])})
        items: list[list[str]] = [[] for _ in texts]
        rows = np.searchsorted(first, at, "right") - 1
        for pair in np.unique(rows[item >= 0] * max(1, len(self.names)) + item[item >= 0]).tolist():
            row, i = divmod(pair, len(self.names))
            items[row].append(self.names[i])
        return pd.DataFrame({"n_words": sizes, "spans": spans, "items": items})


def _index(segments: DataFrame, words: int, size: int) -> Iterator[Windows]:
    """The windows of all segments in sets of about ``size`` bytes of words, one after the other."""
    width = F.aggregate("words", F.lit(0).cast("long"), lambda total, w: total + F.octet_length(w) + 8)
    parts = max(1, -(-(segments.agg(F.sum(width)).first()[0] or 0) // size))
    for part in range(parts):
        mine = segments.filter(F.pmod(F.xxhash64("item", "words"), F.lit(parts)) == part)
        yield Windows([(r["item"], r["words"]) for r in mine.collect()], words)


def _marked(documents: DataFrame, benchmark: DataFrame, words: int, size: int) -> DataFrame:
    """``_doc, _found``: every row of ``documents`` as a struct, and what was found in its text."""
    spark = documents.sparkSession
    bound(spark)
    segments = materialize(item_segments(benchmark, words), "item-segments")
    packed = documents.select(F.struct("*").alias("_doc"))
    sets = _index(segments, words, size)
    index, more = next(sets), next(sets, None)

    def column(index: Windows) -> Column:
        shared = spark.sparkContext.broadcast(index)

        @F.pandas_udf(FOUND)
        def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for series in batches:
                yield shared.value.find(series.tolist())

        return find(F.col("_doc.text")).alias("_found")

    if more is None:
        return packed.select("_doc", column(index))
    # Items beyond one set: rows get a number once, every set is met in a pass of its own, and only rows with hits go on.
    packed = materialize(packed.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    passes = [materialize(packed.select("_row", column(index)), "hits")]
    while more is not None:
        passes.append(materialize(packed.select("_row", column(more)).filter("size(_found.spans) > 0"), "hits"))
        more = next(sets, None)
    hits = passes[0].filter("size(_found.spans) > 0")
    for one in passes[1:]:
        hits = hits.unionByName(one)
    hits = hits.groupBy("_row").agg(  # as many rows as sets, at most
        F.array_sort(F.flatten(F.collect_list("_found.spans"))).alias("_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_found.items")))).alias("_items"))
    empty = F.from_json(F.lit("[]"), "array<struct<first:bigint,last:bigint>>")
    grown = F.aggregate("_spans", empty, lambda done, s: F.when(
        (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["last"] >= s["first"] - 1),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            F.try_element_at(done, F.lit(-1))["first"].alias("first"),
            F.greatest(F.try_element_at(done, F.lit(-1))["last"], s["last"]).alias("last"))))).otherwise(F.concat(done, F.array(s))))
    sizes = passes[0].select("_row", F.col("_found.n_words").alias("_n"))
    joined = packed.join(sizes, "_row").join(hits.select("_row", grown.alias("_spans"), "_items"), "_row", "left")
    found = F.struct(F.col("_n").alias("n_words"), F.coalesce("_spans", empty).alias("spans"),
                     F.coalesce("_items", F.array().cast("array<string>")).alias("items"))
    return joined.select("_doc", found.alias("_found"))


def find_leaks(documents: DataFrame, benchmark: DataFrame, words: int = WORDS, size: int = INDEX_BYTES) -> DataFrame:
    """``doc_id, n_words, n_hit, spans, items`` of every row of ``documents`` (``doc_id, text``).

    Words are runs of ASCII letters (A-Z in lower case), digits and all characters beyond ASCII. A window is ``words`` consecutive words of a text
    of ``benchmark`` (``item_id, text``), or the whole of a shorter one. ``spans`` are the runs of words that lie in occurrences
    of windows (first and last, from 0), ``n_hit`` their words, ``items`` the ids of the items whose windows occur, as strings in order.

    Null, empty and wordless texts have no words; such items have no windows. Windows of items without an id hit words but name nobody.
    Rows are never merged: equal ids or texts give one row each; items with one id count once. Other columns are not read.
    Empty tables give no rows, or no hits. Matches are exact: hashes only lead to them.

    The items' words up to ``size`` bytes go to every task; more than that go in several sets, one scan of the texts for each.
    """
    found = _marked(documents.select("doc_id", "text"), benchmark, words, size)
    n_hit = F.aggregate("_found.spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select(
        F.col("_doc.doc_id").alias("doc_id"), F.col("_found.n_words").alias("n_words"), n_hit.alias("n_hit"),
        F.col("_found.spans").alias("spans"), F.col("_found.items").alias("items"))


def cut_words(text: str | None, spans: list) -> str | None:
    """A text without the words of ``spans`` and what lies between them; the rest stays as it is."""
    if not len(spans):
        return text
    data = text.encode()
    places = [m.span() for m in _RUN.finditer(data.translate(_BLANKED))]
    out, at = [], 0
    for span in spans:
        out.append(data[at:places[span["first"]][0]])
        at = places[span["last"]][1]
    return (b"".join(out) + data[at:]).decode()


def remove_leaks(
    documents: DataFrame, benchmark: DataFrame, whole: bool = False, words: int = WORDS, size: int = INDEX_BYTES
) -> DataFrame:
    """``documents`` with all their columns, without the hit spans of their texts; with ``whole``, without the documents that have any.

    Spans are those of :func:`find_leaks`. Texts without hits stay as they are, nulls included.
    """
    found = _marked(documents, benchmark, words, size)
    if whole:
        return found.filter("size(_found.spans) = 0").select("_doc.*")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([cut_words(t, s) for t, s in zip(texts, spans)], dtype=object)

    return found.withColumn("_text", cut(F.col("_doc.text"), F.col("_found.spans"))).select(
        *[F.col("_text").alias(c) if c == "text" else F.col("_doc")[c].alias(c) for c in documents.columns])
