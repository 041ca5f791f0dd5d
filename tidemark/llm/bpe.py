"""Byte-level BPE: a lazily determinised transducer encodes, an incremental UTF-8 machine decodes.

The tokens of a text prefix end in exactly one last token: the one that may follow the last token before
it. So a machine that reads bytes needs to know only the last tokens of the places that are still open.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.batches import Batches, batch, map_batches, texts

MAX_PAIRS = 1_000_000  # pairs of tokens whose fit is remembered
MAX_PIECES = 200_000  # pieces whose ids are remembered, and as many from before
FLUSH = 4_096  # registers of a long piece that are kept before the shared past is emitted
LONG_PIECE = 64  # longer pieces are not remembered
CHUNK = 8_192  # ids decoded at a time


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a vocabulary file: a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Transducer:
    """Byte strings to token ids, one byte at a time.

    The machine that may begin a token at every byte is determinised as far as texts need it: its state is
    the longest open beginning of a token, and with a state come the tokens that may end there. Which of them does is
    decided by the registers, the last tokens of the earlier places. A token leaves the machine once every place from which
    a token may still be open has it in its past, which looks ahead no further than the longest token.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self.prefixes = {token[:n] for token in ranks for n in range(1, len(token) + 1)}
        self.halves: dict[int, tuple[int, int]] = {}  # the last merge of a token; at most one entry for each token
        self.states: dict[bytes, int] = {}  # at most one for each beginning of a token
        self.open: list[bytes] = []
        self.moves: list[dict[int, int]] = []
        self.ends: list[tuple[tuple[int, int], ...]] = []
        self.pairs: dict[int, bool] = {}
        self._state(b"")

    def _state(self, seen: bytes) -> int:
        if seen not in self.states:
            self.states[seen] = len(self.open)
            self.open.append(seen)
            self.moves.append({})
            tokens = [(len(seen) - i, self.ranks.get(seen[i:])) for i in range(len(seen))]
            self.ends.append(tuple((size, t) for size, t in tokens if t is not None))
        return self.states[seen]

    def _move(self, state: int, byte: int) -> int:
        seen = self.open[state] + bytes([byte])
        while seen not in self.prefixes:
            if not seen:
                raise ValueError("the vocabulary has no token for a byte")
            seen = seen[1:]
        self.moves[state][byte] = self._state(seen)
        return self.moves[state][byte]

    def merged(self, data: bytes, stop: int = 1) -> list[int]:
        """Ids by the definition: merge the pair of lowest rank, the leftmost first, until none or ``stop`` parts are left."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > stop:
            found = [(self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ranks]
            if not found:
                break
            i = min(found)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of a token joins; None for a single byte."""
        if self.sizes[token] == 1:
            return None
        if token not in self.halves:
            parts = self.merged(self.tokens[token], 2)
            self.halves[token] = tuple(parts) if len(parts) == 2 else (-1, -1)
        return self.halves[token]

    def _apart(self, left: int, right: int) -> bool:
        """True when no merge joins the border of two tokens before both are complete.

        Undoes the merges beside the border from the last to the first. A merge across the border wins against one still to
        come: on the left only with a lower rank, on the right also with an equal one, since the leftmost goes first.
        """
        edge = None
        while True:
            across = self.ranks.get(self.tokens[left] + self.tokens[right])
            if across is not None and (edge is None or across < edge):
                return False
            a, b = self._halves(left), self._halves(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                edge, left = left, a[1]
            else:
                edge, right = right + 1, b[0]
            if left < 0 or right < 0:
                return False

    def _fits(self, before: int, token: int, key: int) -> bool:
        """True when ``token`` may follow ``before`` (-1: the start); remembered under ``key``."""
        whole = self._halves(token) != (-1, -1)
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        self.pairs[key] = whole and (before < 0 or self._apart(before, token))
        return self.pairs[key]

    def encode(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        if data in self.ranks:
            return [self.ranks[data]]
        out: list[int] = []
        state, last = 0, [-1]
        moves, ends, known = self.moves, self.ends, self.pairs
        for byte in data:
            state = moves[state].get(byte) or self._move(state, byte)
            for size, token in ends[state]:
                before = last[-size]
                key = (before + 1) << 32 | token
                fit = known.get(key)
                if fit or fit is None and self._fits(before, token, key):
                    last.append(token)
                    break
            else:
                raise ValueError("the merges leave a byte without token")
            if len(last) > FLUSH:
                last = self._emit(last, len(self.open[state]), out)
        tail, place = [], len(last) - 1
        while place > 0:
            tail.append(last[place])
            place -= self.sizes[last[place]]
        out += tail[::-1]
        return out

    def _emit(self, last: list[int], depth: int, out: list[int]) -> list[int]:
        """Append the tokens that all open places share to ``out`` and forget their registers."""
        end = len(last) - 1
        places = set(range(end - depth, end + 1))
        while len(places) > 1:
            place = max(places)
            places.remove(place)
            places.add(place - self.sizes[last[place]])
        shared = place = places.pop()
        found = []
        while place > 0:
            found.append(last[place])
            place -= self.sizes[last[place]]
        out += found[::-1]
        return last[shared:]


class Pieces:
    """Packed ids of pieces; those not asked for while ``MAX_PIECES`` others were are forgotten."""

    def __init__(self, transducer: Transducer):
        self.transducer, self.old = transducer, {}

        class New(dict):
            def __missing__(new, piece: str) -> bytes:
                return self._make(piece)

        self.new = New()
        self.get = self.new.__getitem__

    def _make(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            packed = np.array(self.transducer.encode(piece.encode()), "<u4").tobytes()
        if len(piece) <= LONG_PIECE:
            if len(self.new) >= MAX_PIECES:
                self.old = dict(self.new)
                self.new.clear()
            self.new[piece] = packed
        return packed


class Codec:
    """Texts to packed ids (little-endian unsigned 32-bit integers) and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = regex.compile(pattern).findall
        self.transducer = Transducer(ranks)
        self.pieces = Pieces(self.transducer)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.get, self.split(text)))

    def decode(self, chunks: Iterable[bytes]) -> Iterator[str]:
        """Text of packed ids, piece by piece: a character cut by a chunk waits for its rest."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        token = self.transducer.tokens.__getitem__
        for chunk in chunks:
            yield machine.decode(b"".join(map(token, np.frombuffer(chunk, "<u4").tolist())))
        yield machine.decode(b"", True)


_codecs: dict[tuple[str, str], Codec] = {}


def _codec(path: str, pattern: str) -> Codec:
    """One codec per worker process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(read_ranks(path), pattern)
    return _codecs[path, pattern]


def encode_documents(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` of every row of ``documents`` (``doc_id, text``), ids packed as little-endian unsigned 32-bit integers.

    ``path`` is a rank file that every executor can read, ``pattern`` splits a text into pieces that are encoded
    separately. A null or empty text has no ids. Rows are never merged: equal ids or texts give one row each.
    Other columns are not read. An empty table gives no rows. Nothing is shuffled; memory is one batch of texts,
    a bounded transducer and a bounded memory of pieces.
    """
    kind = dict(documents.dtypes)["doc_id"]
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Batches) -> Batches:
        codec = _codec(path, pattern)
        for rows in batches:
            yield batch(schema, [rows.column(0), [codec.encode(t) for t in texts(rows.column(1))]])

    docs = documents.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text")
    return map_batches(docs, run, "doc_id bigint, ids binary").selectExpr(f"CAST(doc_id AS {kind}) AS doc_id", "ids")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids, text`` of every row of ``encoded`` (``doc_id, ids``); null ids decode to an empty text.

    Bytes that are not UTF-8 decode to replacement characters. Other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("text", pa.string())])

    def run(batches: Batches) -> Batches:
        codec = _codec(path, pattern)
        for rows in batches:
            found = []
            for ids in rows.column(1).to_pylist():
                ids = ids or b""
                found.append("".join(codec.decode(ids[i:i + 4 * CHUNK] for i in range(0, len(ids), 4 * CHUNK))))
            yield batch(schema, [rows.column(0), rows.column(1), found])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id bigint, ids binary, text string")
