"""Exact top-k search by inner product with a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance from it; vectors of a pivot in order of distance form annuli, which
are stored in chunks. A query first meets its own chunk, whose scores give a lower bound for its k-th best. Then the annuli
around every pivot are searched, nearest distances first, as far as the triangle inequality leaves room above that bound.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.batches import Batches, batch, bound, map_batches
from tidemark.session import materialize

SCALE = 256
PIVOTS = 32
RINGS = 8  # annuli of a pivot; each holds any number of chunks
SAMPLE = 4_096  # rows, in order of a hash of their id, that pivots and ring borders are fitted on
CHUNK = 1_024  # vectors of a chunk
BLOCK = 256  # queries that meet a chunk together
CHUNKS_PER_TASK = 16  # chunks of an annulus that one join key holds
EXACT = 1 << 53  # integers up to here are exact as floating-point numbers


class Pivots(NamedTuple):
    """Pivots of the vectors of one length, and the inner borders of their rings."""

    points: np.ndarray
    borders: np.ndarray


def usable(vector: Column) -> Column:
    """False for null vectors and those that hold a null or a number that is not finite."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(fine, F.lit(False))


def _ints(values: pa.Array) -> list[np.ndarray]:
    """``floor(SCALE * x)`` of each vector of a list column."""
    flat = np.floor(values.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if len(flat) and np.abs(flat).max() >= 1 << 62:
        raise ValueError("a component is too large for 64-bit scores")
    return np.split(flat.astype(np.int64), np.cumsum(values.value_lengths().to_numpy())[:-1]) if len(values) else []


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All integer inner products of the rows of two arrays."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(np.float64), b.astype(np.float64)
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


def fit_pivots(sample: list[np.ndarray], pivots: int = PIVOTS, rings: int = RINGS) -> dict[int, Pivots]:
    """Pivots by length of the vectors: each the sample's farthest from those before it; ring borders are quantiles of distance."""
    fitted = {}
    for size in sorted({len(v) for v in sample}):
        points = np.array([v for v in sample if len(v) == size]).reshape(-1, size)
        chosen, away = [0], _distances(points, points[:1])[:, 0]
        while len(chosen) < min(pivots, len(points)) and away.max() > 0:
            chosen.append(int(np.argmax(away)))
            away = np.minimum(away, _distances(points, points[chosen[-1:]])[:, 0])
        d = _distances(points, points[chosen])
        home = d.argmin(1)
        parts = [d[home == p, p] for p in range(len(chosen))]
        borders = np.array([np.quantile(x, np.arange(1, rings) / rings) if len(x) else np.zeros(rings - 1) for x in parts])
        fitted[size] = Pivots(points[chosen], borders)
    return fitted


def _keys(vectors: np.ndarray, fitted: dict[int, Pivots]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest pivot, ring and distance of vectors of one length; without pivots for that length, all from the origin."""
    found = fitted.get(vectors.shape[1])
    if found is None:
        return np.zeros(len(vectors), np.int64), np.zeros(len(vectors), np.int64), np.sqrt((vectors.astype(float) ** 2).sum(1))
    d = _distances(vectors, found.points)
    pivot = d.argmin(1)
    near = d[np.arange(len(d)), pivot]
    return pivot, (near[:, None] > found.borders[pivot]).sum(1), near


def _rows_by_size(rows: pa.RecordBatch, column: int):
    """(size, row numbers, vectors) of each length that occurs in a binary column of 64-bit integers."""
    data = rows.column(column).to_pylist()
    sizes = np.array([len(x) // 8 for x in data])
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield size, at, np.frombuffer(b"".join(data[i] for i in at), np.int64).reshape(len(at), size)


def build_index(vectors: DataFrame, fitted: dict[int, Pivots]) -> DataFrame:
    """Chunks of ``vectors`` (``vec_id, _row, data``) in order of length, pivot, ring and distance.

    One row per chunk: key, least and largest distance from the pivot, largest norm, and the ids, rows and vectors. The rows are range
    partitioned with their id as the last key, so vectors that occur over and over are spread like all others.
    """
    keyed = pa.schema([("size", pa.int32()), ("pivot", pa.int32()), ("ring", pa.int32()), ("dist", pa.float64()),
                       ("vec_id", pa.int64()), ("_row", pa.int64()), ("data", pa.binary())])

    def key(batches: Batches) -> Batches:
        for rows in batches:
            for size, at, found in _rows_by_size(rows, 2):
                pivot, ring, near = _keys(found, fitted)
                part = rows.take(pa.array(at))
                yield batch(keyed, [[size] * len(at), pivot, ring, near, part.column(0), part.column(1), part.column(2)])

    chunked = pa.schema([(n, pa.int32()) for n in ("size", "pivot", "ring", "n")] + [(n, pa.float64()) for n in ("low", "high", "norm")]
                        + [(n, pa.binary()) for n in ("ids", "rows", "data")])

    def chunk(batches: Batches) -> Batches:
        held, now = [], None

        def close():
            ids, rows, data, near = zip(*held)
            found = np.frombuffer(b"".join(data), np.int64).reshape(len(held), now[0]).astype(float)
            norm = np.sqrt((found**2).sum(1).max()) if now[0] else 0.0
            return batch(chunked, [[x] for x in (*now, len(held), min(near), max(near), norm, np.array(ids, np.int64).tobytes(),
                                                 np.array(rows, np.int64).tobytes(), b"".join(data))])

        for rows in batches:
            for size, pivot, ring, near, vec, row, data in zip(*(c.to_pylist() for c in rows.columns)):
                if held and (now != (size, pivot, ring) or len(held) == CHUNK):
                    yield close()
                    held = []
                now = (size, pivot, ring)
                held.append((vec, row, data, near))
        if held:
            yield close()

    order = ["size", "pivot", "ring", "dist", "vec_id", "_row"]
    rows = map_batches(vectors.select("vec_id", "_row", "data"), key,
                       "size int, pivot int, ring int, dist double, vec_id bigint, _row bigint, data binary")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return rows.mapInArrow(chunk, "size int, pivot int, ring int, n int, low double, high double, norm double, ids binary, rows binary, data binary")


def _first_bounds(index: DataFrame, every: int, k: int) -> DataFrame:
    """Queries of the index (``vec_id`` divisible by ``every``) with the k-th best score within their own chunk."""
    schema = pa.schema([("query_id", pa.int64()), ("query_row", pa.int64()), ("size", pa.int32()), ("least", pa.int64()), ("data", pa.binary())])

    def run(batches: Batches) -> Batches:
        for rows in batches:
            for i in range(len(rows)):
                size, ids, own, data = (rows.column(c)[i].as_py() for c in range(4))
                ids, own = np.frombuffer(ids, np.int64), np.frombuffer(own, np.int64)
                found = np.frombuffer(data, np.int64).reshape(len(ids), size)
                at = np.flatnonzero(ids % every == 0)
                if not len(at):
                    continue
                least = np.full(len(at), np.iinfo(np.int64).min)
                if len(ids) > k:
                    scores = _products(found[at], found)
                    scores[np.arange(len(at)), at] = np.iinfo(np.int64).min
                    least = np.sort(np.partition(scores, -k, axis=1)[:, -k:], axis=1)[:, 0]
                yield batch(schema, [ids[at], own[at], [size] * len(at), least, [found[q].tobytes() for q in at]])

    return index.select("size", "ids", "rows", "data").mapInArrow(
        run, "query_id bigint, query_row bigint, size int, least bigint, data binary")


def _room(q: np.ndarray, away: np.ndarray, low, high, norm) -> np.ndarray:
    """Upper bound of the inner product of each query with vectors of an annulus: |q - x| is at least the gap of distances."""
    length = np.sqrt((q.astype(float) ** 2).sum(1))
    gap = np.maximum(np.maximum(away - high, low - away), 0)
    most = np.minimum((length**2 + norm**2 - gap**2) / 2, length * norm)
    return most + 1e-6 * (1 + length * norm + length**2 + norm**2)


def top_k(vectors: DataFrame, every: int, k: int, pivots: int = PIVOTS, sample: int = SAMPLE) -> DataFrame:
    """The ``k`` highest scores of each query among ``vectors`` (``vec_id, embedding``): ``query_id, rank, vec_id, score``.

    Components become ``floor(256 * x)``, scores are integer inner products. Queries are the rows whose vec_id is divisible by
    ``every``; candidates are all rows but the query's own, all ranks where there are fewer than ``k``. Ties go to the smaller
    vec_id. Vectors of another length than the query's are no candidates.

    Rows without id, null vectors and vectors that hold a null or a number that is not finite take no part. Rows with equal ids
    stay rows of their own: each is a candidate and, where it is a query, gets its own ranks. Empty vectors score 0
    with each other. Other columns are not read. An empty table gives no rows.

    Pivots and ring borders are fitted on a bounded sample; every row is indexed and the result is exact whatever the sample. The driver sees one line
    per ring. Chunks of a ring are dealt over as many keys as it takes, and only scores that reach a query's bound are shuffled.
    """
    spark = vectors.sparkSession
    bound(spark)
    schema = pa.schema([("vec_id", pa.int64()), ("_row", pa.int64()), ("data", pa.binary())])

    def scaled(batches: Batches) -> Batches:
        for rows in batches:
            yield batch(schema, [rows.column(0), rows.column(1), [v.tobytes() for v in _ints(rows.column(2))]])

    fine = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = fine.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        "vec_id", F.monotonically_increasing_id().alias("_row"), "embedding")
    rows = materialize(fine.mapInArrow(scaled, "vec_id bigint, _row bigint, data binary"), "vectors")
    picked = rows.orderBy(F.xxhash64("vec_id", "_row"), "vec_id").limit(sample).select("data").collect()
    fitted = fit_pivots([np.frombuffer(r["data"], np.int64) for r in picked], pivots)

    index = materialize(build_index(rows, fitted), "index")
    queries = materialize(_first_bounds(index, every, k), "queries")
    rings = index.groupBy("size", "pivot", "ring").agg(
        F.count("*").alias("chunks"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("norm").alias("norm"))
    rings = [tuple(r) for r in rings.orderBy("size", "pivot", "ring").collect()]  # at most PIVOTS * RINGS per length

    def away(q: np.ndarray, pivot: int) -> np.ndarray:
        found = fitted.get(q.shape[1])
        return _distances(q, found.points[pivot:pivot + 1] if found else np.zeros((1, q.shape[1])))[:, 0]

    block = pa.schema([(n, pa.int32()) for n in ("size", "pivot", "ring", "part")] + [(n, pa.binary()) for n in ("q_ids", "q_rows", "q_least", "q_data")])

    def aim(batches: Batches) -> Batches:
        for found in batches:
            for size, at, q in _rows_by_size(found, 4):
                ids, own, least = (found.column(c).to_numpy()[at] for c in (0, 1, 3))
                for _, pivot, ring, chunks, low, high, norm in (r for r in rings if r[0] == size):
                    open_ = np.flatnonzero(_room(q, away(q, pivot), low, high, norm) >= least)
                    for start in range(0, len(open_), BLOCK):
                        some = open_[start:start + BLOCK]
                        parts = -(-chunks // CHUNKS_PER_TASK)
                        put = [x[some].tobytes() for x in (ids, own, least, q)]
                        yield batch(block, [[size] * parts, [pivot] * parts, [ring] * parts, range(parts), *[[x] * parts for x in put]])

    aimed = queries.mapInArrow(aim, "size int, pivot int, ring int, part int, q_ids binary, q_rows binary, q_least binary, q_data binary")
    parts = spark.createDataFrame([(s, p, r, -(-c // CHUNKS_PER_TASK)) for s, p, r, c, *_ in rings], "size int, pivot int, ring int, parts int")
    dealt = index.join(F.broadcast(parts), ["size", "pivot", "ring"]).withColumn(
        "part", F.pmod(F.xxhash64("ids"), F.col("parts")).cast("int")).drop("parts")
    # Both sides grow with the input, whatever their estimates say.
    met = aimed.hint("merge").join(dealt, ["size", "pivot", "ring", "part"]).select(
        "size", "pivot", "low", "high", "norm", "ids", "rows", "data", "q_ids", "q_rows", "q_least", "q_data")
    best = pa.schema([(n, pa.int64()) for n in ("query_id", "query_row", "vec_id", "_row", "score")])

    def search(batches: Batches) -> Batches:
        for found in batches:
            for i in range(len(found)):
                size, pivot, low, high, norm, *raw = (found.column(c)[i].as_py() for c in range(12))
                ids, own, q_ids, q_own, least = (np.frombuffer(raw[c], np.int64) for c in (0, 1, 3, 4, 5))
                q = np.frombuffer(raw[6], np.int64).reshape(len(q_ids), size)
                open_ = np.flatnonzero(_room(q, away(q, pivot), low, high, norm) >= least)
                if not len(open_):
                    continue
                scores = _products(q[open_], np.frombuffer(raw[2], np.int64).reshape(len(ids), size))
                fit = (scores >= least[open_, None]) & (own[None, :] != q_own[open_, None])
                if len(ids) > 4 * k:  # ids rise within equal scores only by chance, so ties of the k-th are all kept
                    kth = np.partition(np.where(fit, scores, np.iinfo(np.int64).min), -k, axis=1)[:, -k]
                    fit &= scores >= kth[:, None]
                    fit = _first_ties(fit, scores, kth, ids, own, k)
                a, b = np.nonzero(fit)
                yield batch(best, [q_ids[open_][a], q_own[open_][a], ids[b], own[b], scores[a, b]])

    hits = met.mapInArrow(search, "query_id bigint, query_row bigint, vec_id bigint, _row bigint, score bigint")
    order = W.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id", "_row")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _first_ties(fit: np.ndarray, scores: np.ndarray, kth: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Where more than ``k`` scores reach the k-th, keep those above it and the smallest ids that equal it."""
    for q in np.flatnonzero(fit.sum(1) > k):
        at = np.flatnonzero(fit[q])
        keep = at[np.lexsort((own[at], ids[at], -scores[q, at]))[:k]]
        fit[q] = False
        fit[q, keep] = True
    return fit
