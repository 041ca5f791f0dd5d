"""Packing texts into token sequences by cutting-stock column generation.

Every document is cut into full sequences and one remainder. A linear program over the histogram of the remainders'
lengths finds patterns (which lengths share a sequence) and how often each is used; a knapsack prices new
patterns by dynamic programming. The rounded patterns are then given to the ranked documents by joins.
"""

from __future__ import annotations

import os
import re
import zlib
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from tidemark.llm.batches import Batches, batch, map_batches
from tidemark.session import materialize

LENGTH = 2048  # tokens in a sequence
END = 1  # id after every document
UNIT = 2  # the linear program counts lengths in units of so many tokens, rounded up
GAP = 2e-4  # the program stops this close (as a share) to the bounds from dual prices and from total length
STEPS = 1_000  # and after so many pivots at the latest
MAX_WORDS = 400_000  # words whose ids are remembered, and as many from before
LONG_WORD = 64  # longer words are not remembered
RANK_ROWS = 20_000  # rows of a length that one task ranks
BUCKETS = 16  # tasks that rank the rows of a length, at least

_CONTROLS = re.compile("[\x1c-\x1f]")  # white space for ``str.split`` but not for the tokenizer
_SPACE = re.compile("[ \t\n\x0b\f\r]+")



class Words:
    """Packed ids of texts by a ``tokenizers`` file that drops white space.

    Words between white space are encoded apart, which gives the ids of the whole text: the pieces of the
    tokenizer never reach over white space, and composing and lower-casing do not look across it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        # The same model behind a split at blanks alone, for words that the normaliser would not change.
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [_SPACE.split(t) if _CONTROLS.search(t) else t.split() for t in texts]
        wanted = set().union(*split)
        wanted.discard("")
        self.new[""] = b""
        if len(self.new) + len(wanted) > MAX_WORDS:
            self.old, self.new = self.new, {}
        missing = wanted.difference(self.new)
        for word in missing.intersection(self.old):
            self.new[word] = self.old[word]
        self._learn(missing.difference(self.old))
        get = self.new.__getitem__
        found = [b"".join(map(get, words)) for words in split]
        for word in [w for w in wanted if len(w) > LONG_WORD]:
            self.new.pop(word, None)
        return found


    def _learn(self, words: set[str]) -> None:
        """Make the ids of new words. A mark behind letters is a piece of its own, and lower case has the ids of upper case."""
        new = self.new
        simple, others, made = {}, [], []
        for word in words:
            stem = word[:-1] if word[-1] in ",." else word
            # Latin letters in normal form are what the normaliser makes of them, once in lower case; others must be in lower case.
            if stem.isalpha() and (stem.isascii() or is_normalized("NFC", stem) and (
                    "\u0130" not in stem and max(stem) < "\u0250" or stem == stem.lower())):
                low = stem.lower()
                if low not in new:
                    simple[low] = None
                if low is not word and low != word:
                    made.append((word, low, "" if stem is word else word[-1]))
            else:
                others.append(word)
        simple = list(simple)
        for at in range(0, len(simple), 10_000):
            some = simple[at:at + 10_000]
            e = self.plain.encode(" ".join(some), add_special_tokens=False)
            piece = np.array(e.word_ids, np.int64)
            if len(piece) and piece[-1] + 1 == len(some) == np.count_nonzero(np.diff(piece)) + 1:
                ends = (4 * np.searchsorted(piece, np.arange(len(some) + 1))).tolist()
                data = np.array(e.ids, "<u4").tobytes()
                new.update(zip(some, [data[i:j] for i, j in zip(ends, ends[1:])]))
            else:
                others += some
        others += [m for m in ",." if m not in new]
        for at in range(0, len(others), 10_000):
            some = others[at:at + 10_000]
            for word, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                new[word] = np.array(e.ids, "<u4").tobytes()
        new[""] = b""
        for word, low, mark in made:
            new[word] = new[low] + new[mark]


_words: dict[str, Words] = {}


def _encoder(path: str) -> Words:
    """One encoder per worker process."""
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


def _tokens(path: str, texts: list[str | None]) -> list[bytes]:
    end = np.array([END], "<u4").tobytes()
    return [ids + end for ids in _encoder(path).encode([t or "" for t in texts])]


def cut_documents(documents: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """Pieces of every row of ``documents`` (``doc_id, text``): full ones of ``length`` tokens, then the remainder.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens``. A document is its ids followed by the id 1, so a null or empty text
    is one piece of one token. The ids themselves are made again by :func:`sequence_ids` where they are wanted.
    """
    kind = dict(documents.dtypes)["doc_id"]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Batches) -> Batches:
        for rows in batches:
            out: list[list[int]] = [[] for _ in names]
            for doc, ids in zip(rows.column(0).to_pylist(), _tokens(path, rows.column(1).to_pylist()), strict=True):
                size = len(ids) // 4
                for start in range(0, size, length):
                    piece = ids[4 * start:4 * (start + length)]
                    for column, value in zip(out, (doc, start, len(piece) // 4, zlib.crc32(piece), size), strict=True):
                        column.append(value)
            yield batch(schema, out)

    docs = documents.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text")
    cut = map_batches(docs, run, ", ".join(f"{n} bigint" for n in names))
    return cut.withColumn("doc_id", F.col("doc_id").cast(kind))


def best_pattern(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Knapsack by dynamic programming: the dearest set of classes 1..n (of their own size), repeats allowed."""
    n = len(prices)
    value = np.zeros(capacity + 1)
    choice = np.zeros(capacity + 1, int)
    for c in range(1, capacity + 1):
        k = min(c, n)
        gains = prices[:k] + value[c - 1::-1][:k] if c > 1 else prices[:1]
        best = int(np.argmax(gains))
        if gains[best] > value[c - 1] + 1e-12:
            value[c], choice[c] = gains[best], best + 1
        else:
            value[c] = value[c - 1]
    pattern, c = np.zeros(n), capacity
    while c:
        pattern[choice[c] - 1] += choice[c] > 0
        c -= max(choice[c], 1)
    return float(value[capacity]), pattern


def _start(demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """A basis of largest-first patterns: each uses up one class (the third value), which later ones leave out, so the basis is triangular."""
    left = demand.astype(float).copy()
    todo = list(np.flatnonzero(demand)[::-1])
    columns, used, order = [], [], []
    while todo:
        pattern = np.zeros(len(demand))
        spent = todo[0]
        if left[spent] <= 0:
            pattern[spent] = capacity // (spent + 1)
            times = 0.0
        else:
            room = capacity
            for i in todo:
                if left[i] > 0 and i < room:
                    pattern[i] = room // (i + 1)
                    room -= int(pattern[i]) * (i + 1)
            held = np.flatnonzero(pattern)
            ratios = left[held] / pattern[held]
            spent, times = int(held[np.argmin(ratios)]), float(ratios.min())
            left -= pattern * times
            left[spent] = 0
        columns.append(pattern)
        used.append(times)
        order.append(spent)
        todo.remove(spent)
    return np.array(columns).T, np.array(used), order


def solve_program(demand: np.ndarray, capacity: int, gap: float = GAP, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one column each) and how often each is used, fractions included, to cover ``demand`` with few sequences.

    ``demand[i]`` pieces have size ``i + 1``. Revised simplex method: starts with largest-first patterns, prices new ones by
    :func:`best_pattern` and stops near the bounds.
    """
    classes = np.flatnonzero(demand)
    m = len(classes)
    if m == 0:
        return np.zeros((len(demand), 0)), np.zeros(0)
    basis, used, spent = _start(demand, capacity)
    # Row s of the triangular system holds the class that pattern s used up; plain substitution, no threaded linear algebra.
    rows = basis[spent]
    inverse = np.zeros((m, m))
    for s in range(m):
        held = np.flatnonzero(rows[s, :s])
        inverse[s] = -(rows[s, held, None] * inverse[held]).sum(axis=0)
        inverse[s, s] += 1.0
        inverse[s] /= rows[s, s]
    inverse = inverse[:, np.argsort(spent)]
    size = np.where(demand > 0, np.arange(1, len(demand) + 1) / capacity, 0.0)  # prices that no packing can undercut
    least = float(size @ demand)
    prices = np.zeros(len(demand))
    enough = least + max(gap * least, 1.0)  # within a sequence of the bound nothing is left to gain
    for _ in range(steps):
        if used.sum() <= enough:
            break
        prices[classes] = inverse.sum(axis=0)
        pattern = best_pattern((prices + size) / 2, capacity)[1]  # smoothed prices need fewer steps
        if prices @ pattern <= 1 + gap:
            worth, pattern = best_pattern(prices, capacity)
            if worth <= 1 + gap:  # no pattern is worth more than its sequence
                break
        held = np.flatnonzero(pattern[classes])
        entering = (inverse[:, held] * pattern[classes][held]).sum(axis=1)
        ratios = np.where(entering > 1e-9, used / np.maximum(entering, 1e-9), np.inf)
        out = int(np.argmin(ratios))
        step = ratios[out]
        if not np.isfinite(step):
            break
        used = used - step * entering
        used[out] = step
        np.maximum(used, 0, out=used)
        row = inverse[out] / entering[out]
        inverse -= np.outer(entering, row)
        inverse[out] = row
        basis[:, out] = pattern
    return basis, used


def plan_patterns(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole patterns with their counts that hold ``demand`` exactly: the program's, rounded down, and first-fit ones for the rest."""
    basis, used = solve_program(demand.astype(float), capacity)
    left = demand.astype(np.int64).copy()
    plan = []
    for column, times in zip(basis.T.astype(np.int64), used, strict=True):
        held = column > 0
        count = int(min(np.floor(times + 1e-6), np.min(left[held] // column[held])))
        if count > 0:
            plan.append((column, count))
            left -= column * count
    # The rest is less than one sequence per pattern: the largest piece first, then the fullest set beside it.
    while left.any():
        pattern, room = np.zeros_like(left), capacity
        while room:
            fits = np.flatnonzero(left[:room] > pattern[:room])
            if not len(fits):
                break
            size = int(fits[-1]) + 1
            take = min(int(left[size - 1] - pattern[size - 1]), room // size)
            pattern[size - 1] += take
            room -= take * size
        held = pattern > 0
        count = int(np.min(left[held] // pattern[held]))
        plan.append((pattern, count))
        left -= pattern * count
    return plan


def _slots(spark: SparkSession, plan: list[tuple[np.ndarray, int]]) -> DataFrame:
    """Rank intervals of each class and the sequences they go to; its rows number a few per pattern, whatever the corpus."""
    given: dict[int, int] = {}
    rows, first = [], 0
    for pattern, count in plan:
        for unit in np.flatnonzero(pattern).tolist():
            each = int(pattern[unit])
            low = given.get(unit, 0)
            given[unit] = low + each * count
            rows.append((unit + 1, low, given[unit], each, first))
        first += count
    return spark.createDataFrame(rows, "_unit int, _low long, _high long, _each long, _first long")


def pack_documents(documents: DataFrame, path: str, length: int = LENGTH, unit: int = UNIT) -> DataFrame:
    """Sequences of at most ``length`` tokens that hold all ``documents`` (``doc_id, text``) with little padding.

    Returns one row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``; the pieces of a sequence lie
    without gaps from offset 0. Every token lies in exactly one piece; only documents over ``length`` tokens are cut.
    A null or empty text is its end token alone. Rows are never merged: equal ids or texts give their own pieces. Other
    columns are not read. An empty table gives no rows.

    The driver sees the histogram of lengths (at most ``length / unit`` numbers) and the patterns. Pieces are ranked within
    (class, bucket), where a bucket has a bounded number of rows, plus the counts of earlier buckets.
    """
    spark = documents.sparkSession
    capacity = length // unit
    pieces = cut_documents(documents, path, length).withColumn("_unit", F.ceil(F.col("length") / unit).cast("int"))
    pieces = materialize(pieces, "pieces")
    found = {r["_unit"]: r["n"] for r in pieces.groupBy("_unit").agg(F.count("*").alias("n")).collect()}
    demand = np.zeros(capacity, np.int64)
    for size, n in found.items():
        demand[size - 1] = n
    slots = _slots(spark, plan_patterns(demand, capacity))

    buckets = max(BUCKETS, -(-int(demand.max(initial=0)) // RANK_ROWS))
    keys = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    rows = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    inside = W.partitionBy("_unit", "_bucket").orderBy(*keys)
    ranked = rows.withColumn("_rank", F.row_number().over(inside) - 1)
    sizes = rows.groupBy("_unit", "_bucket").agg(F.count("*").alias("_rows"))
    before = W.partitionBy("_unit").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)  # one row per bucket
    starts = sizes.select("_unit", "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    ranked = ranked.join(starts, ["_unit", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    placed = ranked.join(F.broadcast(slots), "_unit").filter("_rank >= _low AND _rank < _high")
    placed = placed.withColumn("sequence_id", F.col("_first") + F.floor((F.col("_rank") - F.col("_low")) / F.col("_each")))
    order = W.partitionBy("sequence_id").orderBy(F.desc("length"), F.col("_rank"), F.col("_unit"))
    earlier = order.rowsBetween(W.unboundedPreceding, -1)  # at most `length` rows in a sequence
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def sequence_ids(documents: DataFrame, packed: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """``sequence_id, offset, ids`` of the pieces of :func:`pack_documents`: the tokens themselves, packed as 32-bit integers.

    Documents are encoded and cut again and meet their pieces by document, start and checksum, so ids need not be kept
    while the patterns are found. Documents are expected to have different ids here.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def run(batches: Batches) -> Batches:
        for rows in batches:
            out: list[list] = [[], [], [], []]
            for doc, ids in zip(rows.column(0).to_pylist(), _tokens(path, rows.column(1).to_pylist()), strict=True):
                for at in range(0, len(ids), 4 * length):
                    piece = ids[at:at + 4 * length]
                    for column, value in zip(out, (doc, at // 4, zlib.crc32(piece), piece), strict=True):
                        column.append(value)
            yield batch(schema, out)

    docs = documents.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text")
    again = map_batches(docs, run, "doc_id bigint, start bigint, ids_crc32 bigint, ids binary")
    return packed.join(again, ["doc_id", "start", "ids_crc32"]).select("sequence_id", "offset", "ids")
