"""Cross-tokenizer alignment: which tokens of one tokenizer stand for which of another, by pointer jumping over byte ranges.

Every token points to the overlapping token that reaches farthest right; a token whose end both sides share points to itself. Doubling the
pointers (every token takes over its successor's successor) until none changes brings all tokens of an overlapping group to its last
token, which labels the group. All new words of a batch are doubled together; words met before are remembered with their groups.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tidemark.llm.batches import Batches, batch, map_batches
from tidemark.operators.skew import lookup_join
from tidemark.session import materialize

CHARS = 1_000_000  # characters of new words that are doubled together; one text is never cut for it
TOGETHER = 200  # new words that are encoded in one call
MAX_WORDS = 150_000  # words that are remembered with their groups, and as many from before
LONG_WORD = 48  # longer ones are not remembered
SHIFT = 1 << 20  # an id pair is one number: a * SHIFT + b

# The pieces into which byte-level BPE of this kind splits a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Beyond these old alphabets, libraries may know letters of different Unicode versions.
_LATER = re.compile("[\u0530-\U0010ffff]")
# Behind what is no white space, a blank before what is none ends a token on both sides and begins the next.
_BETWEEN = re.compile(r" (?=\S)(?<=\S )")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary of a byte-level BPE: itself where printable, else one beyond Latin-1."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteTokens:
    """A byte-level BPE of the ``tokenizers`` library.

    Where every token is the merge of its rank, as usual, its fast twin encodes texts of old alphabets with the same ids.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        letters = byte_letters()
        vocab = described["model"]["vocab"]
        special = {t["content"] for t in described.get("added_tokens", []) if t.get("special")}
        plain = {t: i for t, i in vocab.items() if t not in special}
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in plain.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        merges = [m if isinstance(m, list) else m.split(" ") for m in described["model"]["merges"]]
        split = described.get("pre_tokenizer") or {}
        ranked = [vocab["".join(m)] for m in merges] == list(range(256, 256 + len(merges))) and len(plain) == 256 + len(merges)
        usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        self.lengths = np.array([len(b) for b in self.bytes])
        self.by_word = bool(usual) and described.get("normalizer") is None
        self.fast = None
        if ranked and usual and described.get("normalizer") is None and not described["model"].get("ignore_merges"):
            self.fast = tiktoken.Encoding("twin", pat_str=PATTERN, special_tokens={}, mergeable_ranks={self.bytes[i]: i for i in plain.values()})

    def encode(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(texts)
        slow = []
        for i, text in enumerate(texts):
            if self.fast and (text.isascii() or not _LATER.search(text)):
                out[i] = self.fast.encode_ordinary(text)
            else:
                slow.append(i)
        for i, found in zip(slow, self.library.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False)):
            out[i] = found.ids
        return out


class PieceTokens:
    """A ``sentencepiece`` model. Its texts are without the blank that the model puts before them."""

    def __init__(self, path: str):
        self.library = SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.library.vocab_size()):
            piece = self.library.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.library.is_byte(i) else piece.replace("\u2581", " ").encode())
        self.lengths = np.array([len(b) for b in self.bytes])
        # No piece reaches over the beginning of a word, so words between blanks are encoded apart with the same ids.
        inner = re.compile("[^\u2581]\u2581")
        self.by_word = not any(inner.search(self.library.id_to_piece(i)) for i in range(len(self.bytes)))
        self.by_word = self.by_word and self.library.encode("a  b", out_type=str)[0].startswith("\u2581")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


_loaded: dict[str, ByteTokens | PieceTokens] = {}


def tokens_of(path: str) -> ByteTokens | PieceTokens:
    """The tokenizer of a file, once per worker process; a ``.model`` is one of pieces, anything else a byte-level BPE."""
    if path not in _loaded:
        _loaded[path] = PieceTokens(path) if path.endswith(".model") else ByteTokens(path)
    return _loaded[path]


def last_tokens(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Terminal token of every token, those of the first side before those of the second; sides end together.

    ``a_ends`` and ``b_ends`` are rising ends of byte ranges without gaps.
    """
    n = len(a_ends)
    to_b, to_a = np.searchsorted(b_ends, a_ends), np.searchsorted(a_ends, b_ends)  # the token over the last byte reaches farthest
    succ = np.concatenate([to_b + n, to_a])
    closed = np.flatnonzero(b_ends[to_b] == a_ends)
    succ[closed] = closed
    while True:
        jumped = succ[succ]
        if np.array_equal(jumped, succ):
            return succ
        succ = jumped


class Aligned:
    """Tokens of several texts, their groups and links."""

    def __init__(self, texts: list[str], a: ByteTokens | PieceTokens, b: ByteTokens | PieceTokens):
        spaced = [" " + t for t in texts]
        wanted = [t.encode() for t in spaced]
        sides = [side.encode(texts if isinstance(side, PieceTokens) else spaced) for side in (a, b)]
        self.whole = [all(b"".join(map(side.bytes.__getitem__, ids[k])) == data for side, ids in zip((a, b), sides))
                      for k, data in enumerate(wanted)]
        ends = []
        for name, side, ids in zip("ab", (a, b), sides):
            ids = [one if whole else [] for one, whole in zip(ids, self.whole)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum()))
            setattr(self, f"{name}_ids", flat)
            setattr(self, f"{name}_first", np.concatenate([[0], np.cumsum(sizes)]))
            ends.append(np.cumsum(side.lengths[flat]))
        self.a_ends, self.b_ends = ends
        last = last_tokens(*ends)
        # Groups in order of their last tokens, numbered through all texts: the last token of a group is one of side A.
        group = np.cumsum(last[:len(self.a_ids)] == np.arange(len(self.a_ids))) - 1
        self.a_group, self.b_group = group[last[:len(self.a_ids)]], group[last[len(self.a_ids):]]

    def cut(self, sizes: np.ndarray) -> None:
        """Count as texts what lies between the given numbers of bytes, which tokens of both sides end at."""
        ends = np.concatenate([[0], np.cumsum(sizes)])
        self.a_first, self.b_first = (np.searchsorted(e, ends, "right") for e in (self.a_ends, self.b_ends))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the tokens of every overlapping pair."""
        starts = np.concatenate([[0], self.a_ends[:-1]]) if len(self.a_ends) else self.a_ends
        low = np.searchsorted(self.b_ends, starts, "right")
        many = np.searchsorted(self.b_ends, self.a_ends) - low + 1
        left = np.repeat(np.arange(len(low)), many)
        return left, np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)

    def groups(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of every text."""
        n = len(self.a_ids)
        if not n:
            return [""] * (len(self.a_first) - 1)
        a_count = np.bincount(self.a_group, minlength=1)
        b_count = np.bincount(self.b_group, minlength=1)
        before_b = np.cumsum(b_count) - b_count
        order = np.empty(n + len(self.b_ids), np.int64)
        order[np.arange(n) + before_b[self.a_group]] = np.arange(n)
        order[np.arange(len(self.b_ids)) + np.cumsum(a_count)[self.b_group]] = n + np.arange(len(self.b_ids))
        closes = np.concatenate([np.diff(self.a_group, append=-1) != 0, np.diff(self.b_group, append=-1) != 0])
        ids = np.concatenate([self.a_ids, self.b_ids])
        size = 1 << int(ids.max()).bit_length()
        said = _said(size)
        ids = ids + size * closes * np.where(np.arange(len(ids)) < n, 1, 2)
        parts = [said[i] for i in ids[order].tolist()]
        ends = (self.a_first + self.b_first).tolist()
        return ["".join(parts[i:j])[:-1] for i, j in zip(ends, ends[1:])]


    def pairs(self) -> list[bytes]:
        """Packed id pairs of all links of every text."""
        left, right = self.links()
        data = (self.a_ids[left] * SHIFT + self.b_ids[right]).tobytes()
        cuts = (8 * np.searchsorted(left, self.a_first)).tolist()
        return [data[i:j] for i, j in zip(cuts, cuts[1:])]


@lru_cache(4)
def _said(size: int) -> list[str]:
    """Ids below ``size`` as text before another of their side, as the last of side A and as the last of side B."""
    return [f"{i}{mark}" for mark in ",|;" for i in range(size)]


class Aligner:
    """Groups and links of texts, word by word where both tokenizers work that way."""

    def __init__(self, a: ByteTokens | PieceTokens, b: ByteTokens | PieceTokens):
        self.a, self.b = a, b
        self.by_word = a.by_word and b.by_word
        self.new: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def _learn(self, words: list[str]) -> dict[str, tuple]:
        """Groups, packed pairs and number of A tokens of words; None for a word whose tokens have other bytes."""
        alone = [w for w in words if not self.by_word or len(w) > LONG_WORD or w[0].isspace() or w[-1].isspace() or "\u2581" in w]
        apart = set(alone)
        lists = [w for w in words if w not in apart]
        lists = [lists[i:i + TOGETHER] for i in range(0, len(lists), TOGETHER)] + [[w] for w in alone]
        out: dict[str, tuple] = {}
        while lists:
            size, some, rest = 0, [], []
            for words in lists:
                more = sum(map(len, words))
                if not some or size + more <= CHARS:
                    some.append(words)
                    size += more
                else:
                    rest.append(words)
            found = Aligned([" ".join(words) for words in some], self.a, self.b)
            for words, whole in zip(some, found.whole):
                if not whole and len(words) > 1:  # one of them is at fault
                    rest += [[w] for w in words]
                elif not whole:
                    out[words[0]] = None
            good = [w for words, whole in zip(some, found.whole) if whole for w in words]
            found.cut(np.fromiter((len(w) + 1 if w.isascii() else len(w.encode()) + 1 for w in good), np.int64, len(good)))
            out.update(zip(good, zip(found.groups(), found.pairs(), np.diff(found.a_first).tolist())))
            lists = rest
        return out

    def align(self, texts: list[str | None]) -> list[tuple[str, bytes, int] | None]:
        """Groups, packed pairs and number of A tokens of texts; None where there are no tokens."""
        split = [(_BETWEEN.split(t) if self.by_word and "\u2581" not in t else [t]) if t else [] for t in texts]
        wanted = set().union(*split)
        if len(self.new) + len(wanted) > MAX_WORDS:
            self.old, self.new = self.new, {}
        missing = wanted.difference(self.new)
        known = {w: self.old[w] for w in missing.intersection(self.old)}
        known |= self._learn(list(missing.difference(self.old)))
        self.new |= known
        get, out = self.new.__getitem__, []
        for words in split:
            told = list(map(get, words))
            if not told or None in told:
                out.append(None)
            else:
                groups, pairs, n_a = zip(*told)
                out.append((";".join(groups), b"".join(pairs), sum(n_a)))
        for word in [w for w in known if len(w) > LONG_WORD]:
            del self.new[word]
        return out


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One per worker process."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(tokens_of(a_path), tokens_of(b_path))
    return _aligners[a_path, b_path]


def align_documents(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times`` of every row of ``documents`` (``doc_id, text``).

    Side A reads a blank and the text, side B the text (a piece model puts the blank itself); strings of special tokens are plain text. ``groups`` lists
    ids between byte offsets where tokens of both sides end: ``a1,a2|b1;a3|b2,b3``. ``pairs`` are the different id pairs of overlapping
    tokens (``a * SHIFT + b``), ``times`` how often each is linked in the text, ``n_links`` all of them.

    Null and empty texts, and those whose tokens' bytes are not the blank and the text, have no tokens: zeros and empty lists. Rows are never
    merged: equal ids or texts give one row each. Other columns are not read. An empty table gives no rows. Tokenizer files must lie where
    every executor can read them.
    """
    kind = dict(documents.dtypes)["doc_id"]
    schema = pa.schema([*((n, pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), ("groups", pa.string()),
                        ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])

    def run(batches: Batches) -> Batches:
        both = aligner(a_path, b_path)
        for rows in batches:
            out: list[list] = [[] for _ in range(7)]
            for found in both.align(rows.column(1).to_pylist()):
                groups, pairs, n_a = found or ("", b"", 0)
                pair, times = np.unique(np.frombuffer(pairs, np.int64), return_counts=True)
                n_links, n_groups = len(pairs) // 8, groups.count(";") + 1 if groups else 0
                # Links run from group to group like beads: a group has one link less than tokens.
                for column, value in zip(out, (n_a, n_links + n_groups - n_a, n_groups, n_links, groups, pair, times.astype(np.int32))):
                    column.append(value)
            yield batch(schema, [rows.column(0), *out])

    docs = documents.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text")
    columns = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs array<bigint>, times array<int>"
    return map_batches(docs, run, columns).withColumn("doc_id", F.col("doc_id").cast(kind))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n, best``: in how many rows each id pair is linked, and whether no pair of its A id is in more rows."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = materialize(counts.withColumn("_a", F.floor(F.col("pair") / SHIFT)), "pair-counts")
    most = counts.groupBy("_a").agg(F.max("n").alias("_most"))  # one row per id of A
    return counts.join(F.broadcast(most), "_a").select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))


def align_corpus(documents: DataFrame, a_path: str, b_path: str, groups: Column | None = None) -> DataFrame:
    """Rows of :func:`align_documents` with ``n_best``, the links whose pair is the most frequent of its A id in the corpus, and ``count_sum``,
    the corpus-wide counts of the pairs of all links together. ``groups`` may be an expression to keep in place of the list of groups."""
    rows = align_documents(documents, a_path, b_path)
    rows = rows.withColumn("groups", F.col("groups") if groups is None else groups)
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    known = materialize(pair_counts(rows), "known-pairs")
    links = rows.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("_p")).select(
        "_row", F.col("_p.pairs").alias("pair"), F.col("_p.times").alias("_times"))
    met = lookup_join(links, known, ["pair"]).groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("_times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("_times")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return rows.join(met, "_row", "left").select(
        *[c for c in rows.columns if c != "_row"], F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"))
