"""Vector code compression: every vector as one codebook index per part, learnt by k-means with norm-of-sum bounds.

A part that was compared with the whole codebook in round t keeps its entry and a lower bound of its distance to all others. In a later
round r the bound loses the largest net displacement, the norm of the sum of an entry's moves from t to r, which the kept codebook history
gives exactly and which is never more than the moves added up. Only parts whose own entry is no longer safely nearest are compared
with the whole codebook again. As any stamp can be met by any later round, bounds are written down only when they have worn out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import Batches, batch, map_batches
from tidemark.operators.skew import lookup_join
from tidemark.session import materialize

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096  # components are rounded down to multiples of 1 / SCALE
WORN = 0.5  # bounds are written anew when a round had to compare more than this share of the parts with the whole codebook
LIMIT = 1 << 28  # scaled components beyond this are an error: squared distances would not fit 64 bits

_SAFE = 1e-9  # share by which distances are widened against rounding
_STATE = "code binary, stamp binary, bound binary"
_PASS = "rescans bigint, sums array<bigint>"


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, x`` of usable rows, ``x`` the components as little-endian 32-bit integers ``floor(scale * component)``.

    Rows without a vector, and with an empty one or a null or non-finite component, are left out.
    """
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("x", pa.binary())])

    def run(batches: Batches) -> Batches:
        for rows in batches:
            found = []
            for v in rows.column(2).to_pylist():
                x = np.floor(np.array(v, np.float64) * scale)
                if np.abs(x).max(initial=0) > LIMIT:
                    raise ValueError(f"a component is beyond {LIMIT / scale:g}")
                found.append(x.astype("<i4").tobytes())
            yield batch(schema, [rows.column(0), rows.column(1), found])

    whole = "embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < double('Infinity'))"
    usable = vectors.filter(whole).selectExpr(
        "CAST(vec_id AS bigint) AS vec_id", "CAST(label AS string) AS label", "CAST(embedding AS array<double>) AS embedding")
    return map_batches(usable, run, "vec_id bigint, label string, x binary")


def _parts(column: pa.Array, parts: int, width: int) -> np.ndarray:
    """Vectors of a batch as (row, part, position)."""
    data = column.to_pylist()
    if any(len(x) != 4 * parts * width for x in data):
        raise ValueError("vectors must have the same length, a multiple of the number of parts")
    return np.frombuffer(b"".join(data), "<i4").reshape(len(data), parts, width).astype(np.int64)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return (d * d).sum(axis=-1)


def net_moves(history: list[np.ndarray]) -> np.ndarray:
    """``[t, part, code]``: the largest net displacement since round t among all entries but ``code``."""
    now = history[-1]
    out = []
    for then in history:
        moved = np.sqrt(squared(now, then).astype(np.float64)) * (1 + _SAFE)
        n = moved.shape[1]
        others = np.where(np.eye(n, dtype=bool)[None], 0.0, np.broadcast_to(moved[:, None, :], (len(moved), n, n)))
        out.append(others.max(axis=2))
    return np.array(out)


def assign(
    x: np.ndarray, history: list[np.ndarray], state: tuple[np.ndarray, np.ndarray, np.ndarray] | None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """``code, stamp, bound, error`` of every part under the last codebook of ``history``, and how many were compared with all entries.

    ``error`` is the squared distance to the nearest entry, the lowest index among equals. Without a ``state`` all parts are compared.
    """
    codebook = history[-1]
    n, parts, _ = x.shape
    part = np.arange(parts)
    if state is None:
        code, stamp, low = np.zeros((n, parts), np.int64), np.zeros((n, parts), np.int64), np.full((n, parts), -1.0)
    else:
        code, stamp, low = (s.astype(kind) for s, kind in zip(state, (np.int64, np.int64, np.float64)))
    error = squared(x, codebook[part, code])
    moved = net_moves(history)[stamp, part, code]
    open_ = np.sqrt(error.astype(np.float64)) * (1 + _SAFE) >= low - moved
    bound = low.astype(np.float32)
    for p in part:
        at = np.flatnonzero(open_[:, p])
        if len(at):
            d = squared(x[at, p, None, :], codebook[p][None])
            best = d.argmin(axis=1)
            code[at, p], stamp[at, p] = best, len(history) - 1
            error[at, p] = d[np.arange(len(at)), best]
            d[np.arange(len(at)), best] = np.iinfo(np.int64).max
            second = np.sqrt(d.min(axis=1).astype(np.float64)) * (1 - _SAFE)
            bound[at, p] = np.nextafter(second.astype(np.float32), np.float32(-1))
    return code, stamp, bound, error, int(open_.sum())


def _sums(x: np.ndarray, code: np.ndarray, entries: int) -> np.ndarray:
    """``[part, entry, width + 1]``: sums of the parts of every entry by position, and their number."""
    n, parts, width = x.shape
    out = np.zeros((parts, entries, width + 1), np.int64)
    for p in range(parts):
        np.add.at(out[p], code[:, p], np.concatenate([x[:, p], np.ones((n, 1), np.int64)], axis=1))
    return out


def _round(rows: DataFrame, history: list[np.ndarray], keep: bool) -> DataFrame:
    """One pass over the vectors: per task a row with the sums of its parts by entry; with ``keep`` also every vector with fresh bounds."""
    parts, entries, width = history[-1].shape
    has_state = "code" in rows.columns
    names = ["vec_id", "label", "x", *(("code", "stamp", "bound") if has_state else ())]
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("x", pa.binary()), ("code", pa.binary()), ("stamp", pa.binary()),
                        ("bound", pa.binary()), ("rescans", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches: Batches) -> Batches:
        total, rescans = np.zeros((parts, entries, width + 1), np.int64), 0
        for found in batches:
            if not len(found):
                continue
            x = _parts(found.column(2), parts, width)
            code, stamp, bound, _, n = assign(x, history, _state(found, parts) if has_state else None)
            total += _sums(x, code, entries)
            rescans += n
            if keep:
                packed = [[r.tobytes() for r in a] for a in (code.astype(np.uint8), stamp.astype(np.uint8), bound)]
                yield batch(schema, [*(found.column(i) for i in range(3)), *packed, [None] * len(x), [None] * len(x)])
        yield batch(schema, [*[[None]] * 6, [rescans], [total.reshape(-1)]])

    return map_batches(rows.select(*names), run, f"vec_id bigint, label string, x binary, {_STATE}, {_PASS}")


def _state(rows: pa.RecordBatch, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(
        np.frombuffer(b"".join(rows.column(i).to_pylist()), kind).reshape(-1, parts)
        for i, kind in ((3, np.uint8), (4, np.uint8), (5, np.float32)))


def learn_codes(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, list[np.ndarray], list[float]]:
    """Vectors with bounds, the codebook history (``[part, entry, position]`` each) and the share of parts compared with all entries by round.

    The driver sees the sums of the entries, a fixed number whatever the table.
    """
    rows = materialize(scaled(vectors, scale), "scaled-vectors")
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()
    if not first:
        return rows, [np.zeros((parts, 0, 0), np.int64)], []
    width = len(first[0]["x"]) // 4 // parts
    if not width or len(first[0]["x"]) != 4 * parts * width:
        raise ValueError("vectors must have the same length, a multiple of the number of parts")
    start = np.array([np.frombuffer(r["x"], "<i4") for r in first], np.int64).reshape(len(first), parts, width)
    history, shares, keep = [start.transpose(1, 0, 2)], [], True
    for _ in range(rounds):
        done = _round(rows, history, keep)
        if keep:
            done = materialize(done, "bounds")
            rows = done.filter("sums IS NULL").drop("rescans", "sums")
        # A row per task, written down before it is added up twice.
        told = done.filter("sums IS NOT NULL").select("rescans", "sums")
        told = told if keep else materialize(told, "sums")
        flat = told.select(F.posexplode("sums").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"))
        seen = told.agg(F.sum("rescans").alias("n")).select(F.lit(-1).alias("at"), "n")
        found = {r["at"]: r["n"] for r in flat.unionByName(seen).collect()}
        total = np.array([found[i] for i in range(parts * len(first) * (width + 1))], np.int64).reshape(parts, len(first), width + 1)
        count = total[:, :, width:]
        history.append(np.where(count > 0, total[:, :, :width] // np.maximum(count, 1), history[-1]))
        shares.append((found[-1] or 0) / max(1, int(count.sum())))
        keep = shares[-1] > WORN
    return rows, history, shares


def encode_vectors(rows: DataFrame, history: list[np.ndarray]) -> DataFrame:
    """``vec_id, label, codes, error`` of rows that :func:`learn_codes` returns: one byte per part, and the squared error of all parts."""
    parts, _, width = history[-1].shape
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("codes", pa.binary()), ("error", pa.int64())])
    has_state = "code" in rows.columns
    names = ["vec_id", "label", "x", *(("code", "stamp", "bound") if has_state else ())]

    def run(batches: Batches) -> Batches:
        for found in batches:
            if len(found):
                x = _parts(found.column(2), parts, width)
                code, _, _, error, _ = assign(x, history, _state(found, parts) if has_state else None)
                yield batch(schema, [found.column(0), found.column(1), [c.tobytes() for c in code.astype(np.uint8)], error.sum(axis=1)])

    return map_batches(rows.select(*names), run, "vec_id bigint, label string, codes binary, error bigint")


def compress_vectors(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, codes, error, label_error`` of ``vectors`` (``vec_id, embedding, label``), and the codebooks ``[part, entry, position]``.

    Components become integers ``floor(scale * component)``; vectors are cut into equal consecutive parts. The codebook of a part starts with
    that part of the vectors with the smallest ids (equal ids: the smaller bytes first, no id: last). Every round gives each part its
    nearest entry (ties: the lower index) and moves entries to the mean of their parts, rounded down; unused entries stay. ``codes`` has a byte per part,
    ``error`` the squared distances, ``label_error`` their sum over rows with the same label, rows without a label together.

    Rows without a vector, and with an empty one or a null or non-finite component, are left out. Rows are never merged. Vectors of different length are an
    error. Fewer rows than ``entries`` give smaller codebooks, an empty table no rows. Other columns are not read.
    """
    rows, history, _ = learn_codes(vectors, parts, entries, rounds, scale)
    found = materialize(encode_vectors(rows, history), "vector-codes")
    label = F.coalesce(F.concat(F.lit("="), F.col("label")), F.lit("")).alias("_label")
    sums = found.groupBy(label).agg(F.sum("error").alias("label_error"))
    placed = lookup_join(found.select("*", label), materialize(sums, "label-errors"), ["_label"])
    return placed.drop("_label").select(
        F.col("vec_id").cast(dict(vectors.dtypes)["vec_id"]).alias("vec_id"), F.col("label").cast(dict(vectors.dtypes)["label"]).alias("label"),
        "codes", "error", "label_error"), history[-1]


def decompress_vectors(codes: DataFrame, codebooks: np.ndarray, scale: int = SCALE) -> DataFrame:
    """``vec_id, embedding`` of ``codes`` (``vec_id, codes``): the middle of what the entries' integers stand for."""
    schema = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32()))])

    def run(batches: Batches) -> Batches:
        part = np.arange(len(codebooks))
        for rows in batches:
            found = [((codebooks[part, np.frombuffer(c, np.uint8)].reshape(-1) + 0.5) / scale).astype(np.float32) for c in rows.column(1).to_pylist()]
            yield batch(schema, [rows.column(0), found])

    return map_batches(codes.selectExpr("CAST(vec_id AS bigint) AS vec_id", "codes"), run, "vec_id bigint, embedding array<float>")
