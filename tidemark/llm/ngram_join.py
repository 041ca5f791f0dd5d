"""N-gram Jaccard join: every pair of texts whose word shingles agree enough, and what they connect.

Texts become sets of 64-bit shingle hashes; equal sets are joined through one representative. A pair that reaches
the threshold shares one of the rarest shingles of both (prefix filter), so representatives meet under those. The members of a shingle
are cut into tiles of similar set size; within two tiles, hashed bitmaps bound every overlap from above by bit counts,
and the sets of the members that are left are compared until each key's members are connected; pairs are not written down.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import session
from tidemark.llm.batches import Batches, batch, bound, map_batches, texts
from tidemark.operators.skew import fits_broadcast, lookup_join

WORDS = 5
PERCENT = 80  # least share of the union that two sets have in common
SKETCH_BITS = 18  # counters of the shingle sketch: 2 ** 18, whatever the corpus
BITS_EACH = 4  # least bits of a bitmap for each element of its set
TILE = 512  # members in a tile
HOT = 50_000  # shingles that the sketch counts more often than this are dealt over parts
PARTS = 64
MAX_VOCABULARY = 200_000  # word hashes that are remembered
MAX_SEEN = 500_000  # sets of a task that are remembered, to skip their copies
PAIRS = 100_000  # pairs handed on at once

SHORT_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(64)], np.uint64)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """A table in the shared folder. The shuffles that made it are not read again, so their files go as soon as it is written."""
    conf = df.sparkSession.conf
    before = conf.get(SHORT_SHUFFLES)
    conf.set(SHORT_SHUFFLES, "true")
    try:
        return session.materialize(df, label)
    finally:
        conf.set(SHORT_SHUFFLES, before)


def discard(table: DataFrame) -> None:
    """Remove a table of :func:`materialize` that nothing reads any more."""
    row = table.select("_metadata.file_path").first()
    if row:
        session.remove(table.sparkSession, row["file_path"].rsplit("/", 1)[0])


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_VOCABULARY:
            self.clear()
        self[word] = xxhash.xxh64_intdigest(word)
        return self[word]


_hashes = _Hashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread a linear hash over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the different shingles of ``words`` words; a shorter text is one shingle, no words give none."""
    found = text.encode().lower().split()  # of bytes, these know A-Z and the six ASCII spaces only
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - words + 1)
    total = np.full(n, min(len(h), words), np.uint64)
    for k in range(min(words, len(h))):
        total += h[k:k + n] * _FACTORS[k + 1]
    return np.unique(_mixed(total))


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _sets(rows: pa.RecordBatch, words: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """Id and shingles of every text that has any."""
    for text in texts(rows.column(1)):
        s = shingle_set(text, words)
        if len(s):
            yield xxhash.xxh128_digest(s.tobytes()), s


class _Seen(set):
    """True for a set seen before in this task; forgetting one only lets a copy through."""

    def __call__(self, v: bytes) -> bool:
        if v in self:
            return True
        if len(self) >= MAX_SEEN:
            self.clear()
        self.add(v)
        return False


def document_sets(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, n_shingles, v`` of every row, and per task one row with ``sketch``, its shingle counts by hash bucket.

    Equal sets have equal ``v`` (128 bits), empty sets none. Copies within a task are counted once.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("v", pa.binary()), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Batches) -> Batches:
        counts, seen = np.zeros(1 << SKETCH_BITS, np.int64), _Seen()
        for rows in batches:
            sizes, ids, fresh = [], [], []
            for text in texts(rows.column(1)):
                s = shingle_set(text, words)
                v = xxhash.xxh128_digest(s.tobytes()) if len(s) else None
                sizes.append(len(s))
                ids.append(v)
                if v and not seen(v):
                    fresh.append(s)
            if fresh:
                counts += np.bincount(_bucket(np.concatenate(fresh)), minlength=1 << SKETCH_BITS)
            yield batch(schema, [rows.column(0), sizes, ids, [None] * len(ids)])
        yield batch(schema, [[None], [None], [None], [counts]])

    docs = documents.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text")
    return map_batches(docs, run, "doc_id bigint, n_shingles bigint, v binary, sketch array<bigint>")


def _counts(found: DataFrame) -> np.ndarray:
    """The sketch of the whole corpus: a fixed number of counters, added up in every task first."""
    rows = found.filter("sketch IS NOT NULL").select(F.posexplode("sketch").alias("bucket", "n"))
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in rows.filter("n > 0").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        total[r["bucket"]] = r["n"]
    return total


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """So many of the first shingles of a set meet those of every partner, in any order common to all sets."""
    return n - -(-percent * n // 100) + 1


def bitmap(s: np.ndarray) -> bytes:
    """Hashed bitmap of a set, a power of two of bits long and at least 64.

    Two sets differ in at least as many elements as their bitmaps, folded to one length, differ in bits.
    """
    size = max(64, 1 << (BITS_EACH * len(s) - 1).bit_length())
    flags = np.zeros(size, bool)
    flags[(s & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def _folded(wide: int, size: int, to: int) -> int:
    """A bitmap of ``size`` bits as one of ``to`` bits."""
    while size > to:
        size //= 2
        wide = (wide & ((1 << size) - 1)) | (wide >> size)
    return wide


def most_common(a: bytes, b: bytes, n: int) -> int:
    """Upper bound of the elements common to two sets with bitmaps ``a`` and ``b`` and ``n`` elements together."""
    size = 8 * min(len(a), len(b))
    x, y = (_folded(int.from_bytes(z, "little"), 8 * len(z), size) for z in (a, b))
    return (n - (x ^ y).bit_count()) // 2


def signatures(documents: DataFrame, counts: np.ndarray, words: int, percent: int, hot: int) -> DataFrame:
    """``v, n, bits, prefix, common``: the shingles a set is looked up by, the rare ones first; ``common`` those over ``hot``.

    The order is (count of the shingle's bucket in octave quarters, hash): passages that many texts share come last.
    """
    level = (4 * np.log2(np.maximum(counts, 1))).astype(np.uint64) << np.uint64(56)
    often = counts > hot
    schema = pa.schema([("v", pa.binary()), ("n", pa.int32()), ("bits", pa.binary()),
                        ("prefix", pa.list_(pa.int64())), ("common", pa.list_(pa.int64()))])

    def run(batches: Batches) -> Batches:
        seen = _Seen()
        for rows in batches:
            out: list[list] = [[], [], [], [], []]
            for v, s in _sets(rows, words):
                if seen(v):
                    continue
                bucket = _bucket(s)
                first = np.argsort(level[bucket] | s >> np.uint64(8), kind="stable")[:prefix_length(len(s), percent)]
                many = often[bucket[first]]
                taken = s[first].view(np.int64)
                for column, value in zip(out, (v, len(s), bitmap(s), taken[~many], taken[many]), strict=True):
                    column.append(value)
            yield batch(schema, out)

    return map_batches(documents.select("doc_id", "text"), run,
                       "v binary, n int, bits binary, prefix array<bigint>, common array<bigint>")


def _postings(signed: DataFrame) -> DataFrame:
    """``key, part, v, n``: one row per looked-up shingle; common shingles are dealt over parts by set, others have part -1."""
    part = F.pmod(F.xxhash64("v"), F.lit(PARTS)).cast("int")
    rare = signed.select(F.explode("prefix").alias("key"), F.lit(-1).alias("part"), "v", "n")
    return rare.unionByName(signed.select(F.explode("common").alias("key"), part.alias("part"), "v", "n"))


def shared_postings(postings: DataFrame) -> DataFrame:
    """Postings of the keys that more than one set has, with the first set of the key and part as ``pivot, pivot_n``.

    Rows stream by in order of key; only the pivot of the current run is held, so a run may be of any length. Parts of common
    keys are returned even if they have one set.
    """
    schema = pa.schema([("key", pa.int64()), ("part", pa.int32()), ("v", pa.binary()), ("n", pa.int32()),
                        ("pivot", pa.binary()), ("pivot_n", pa.int32())])

    def run(batches: Batches) -> Batches:
        open_run, pivot, shown, before = None, (b"", 0), False, b""
        for rows in batches:
            size = len(rows)
            if not size:
                continue
            key, part, n = (rows.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
            new = np.ones(size + 1, bool)
            new[1:size] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
            new[0] = open_run != (key[0], part[0])
            # Most shingles are alone: only rows with company, parts of common keys and the two ends are looked at.
            wanted = ~new[:size] | ~new[1:] | (part >= 0)
            wanted[0] = wanted[-1] = True
            places = np.flatnonzero(wanted)
            sets = rows.column(2).take(pa.array(places)).to_pylist()
            out: list[list] = [[] for _ in schema]
            for i, v in zip(places.tolist(), sets):
                if new[i]:
                    open_run, pivot, shown = (int(key[i]), int(part[i])), (v, int(n[i])), part[i] >= 0
                    fresh = [(v, int(n[i]))] if shown else []
                elif v == before:  # a copy of the set from another task
                    continue
                else:
                    fresh = [(v, int(n[i]))] if shown else [pivot, (v, int(n[i]))]
                    shown = True
                before = v
                for one, n_one in fresh:
                    for column, value in zip(out, (*open_run, one, n_one, *pivot)):
                        column.append(value)
            yield batch(schema, out)

    rows = postings.select("key", "part", "v", "n").repartition("key", "part").sortWithinPartitions("key", "part", "v")
    return rows.mapInArrow(run, "key bigint, part int, v binary, n int, pivot binary, pivot_n int")


def _gathered(shared: DataFrame, hot: int) -> DataFrame:
    """``key, part, v, n``: the rows in which sets meet in tiles; keys with the same first set are put together.

    Near copies share many keys and few first sets, so a bitmap travels once for each first set. Whatever shares a key still
    meets. Keys stay apart where over ``hot`` sets would come together, and so do the parts of common keys.
    """
    rows = shared.withColumn("_first", F.xxhash64("pivot"))
    sizes = rows.filter("part < 0").select("_first", "v").distinct().groupBy("_first").agg(F.count("*").alias("_size"))
    wide = materialize(sizes.filter(F.col("_size") > hot).select("_first", F.lit(True).alias("_wide")), "wide-groups")
    rows = lookup_join(rows, wide, ["_first"])
    apart = (F.col("part") >= 0) | F.coalesce("_wide", F.lit(False))
    return rows.select(F.when(apart, F.col("key")).otherwise(F.col("_first")).alias("key"), "part", "v", "n").distinct()


def _bound(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` whose bitmaps leave room for the threshold: bits that differ are elements that differ."""
    left, right = (bits.select(F.col("v").alias(x), F.col("bits").alias(f"{x}_bits"), F.col("n").alias(f"{x}_n")) for x in "ab")

    def run(batches: Batches) -> Batches:
        for rows in batches:
            keep = []
            for a, b, n, m in zip(*(rows.column(i).to_pylist() for i in range(2, 6))):
                keep.append((100 + percent) * most_common(a, b, n + m) >= percent * (n + m))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([rows.column(0).filter(keep), rows.column(1).filter(keep)], names=["a", "b"])

    met = pairs.join(left, "a").join(right, "b").select("a", "b", "a_bits", "b_bits", "a_n", "b_n")
    return met.mapInArrow(run, "a binary, b binary")


def _exact(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` whose sorted sets intersect in enough elements."""
    left, right = (sets.select(F.col("v").alias(x), F.col("s").alias(f"{x}_s")) for x in "ab")

    def run(batches: Batches) -> Batches:
        for rows in batches:
            keep = []
            for x, y in zip(rows.column(2), rows.column(3)):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([rows.column(0).filter(keep), rows.column(1).filter(keep)], names=["a", "b"])

    met = pairs.join(left, "a").join(right, "b").select("a", "b", "a_s", "b_s")
    return met.mapInArrow(run, "a binary, b binary")


def _cuts(sizes: np.ndarray) -> list[int]:
    """Where sorted sizes are cut into tiles: at most TILE members each, none a quarter larger than the first."""
    cuts = [0]
    while cuts[-1] < len(sizes):
        cuts.append(min(cuts[-1] + TILE, int(np.searchsorted(sizes, 1.25 * sizes[cuts[-1]], "right"))))
    return cuts


def _candidates(n: list, c: list, bits: list, side: list, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Members in different components and of different sides (null: no sides) that sizes and bitmaps allow, tile by tile: numbers of
    the members of two tiles and a matrix that has their pairs, each once."""
    order = np.argsort(n, kind="stable")
    sizes = np.array(n, np.int64)[order]
    group = np.unique(c, return_inverse=True)[1][order]
    sides = np.array([-1 if x is None else x for x in side])[order]
    widths = np.array([len(x) // 8 for x in bits])[order]

    def maps(tile: slice, width: int) -> np.ndarray:
        """Bitmaps of a tile in ``width`` 64-bit words."""
        found = np.zeros((len(order[tile]), width), np.uint64)
        for row, i in zip(found, order[tile]):
            np.bitwise_or.reduce(np.frombuffer(bits[i], np.uint64).reshape(-1, width), axis=0, out=row)
        return found

    cuts = _cuts(sizes)
    tiles = [slice(*ends) for ends in zip(cuts, cuts[1:])]
    for i, x in enumerate(tiles):
        for j, y in enumerate(tiles[i:], i):
            if 100 * sizes[x.stop - 1] < percent * sizes[y.start]:
                break
            fit = (group[x, None] != group[None, y]) & (100 * sizes[x, None] >= percent * sizes[None, y])
            fit &= (sides[x, None] < 0) | (sides[x, None] != sides[None, y])
            if i == j:
                fit = np.triu(fit, 1)
            if not fit.any():
                continue
            both = sizes[x, None] + sizes[None, y]
            width = int(min(widths[x].min(), widths[y].min()))
            left, right = maps(x, width), maps(y, width)
            apart = np.array([np.bitwise_count(row ^ right).sum(axis=1, dtype=np.int64) for row in left])
            fit &= (100 + percent) * ((both - apart) // 2) >= percent * both
            if fit.any():
                yield order[x], order[y], fit


def _cross(v: list, n: list, c: list, bits: list, side: list, percent: int) -> Iterator[tuple[bytes, bytes]]:
    """Pairs in different components and of different sides (null: no sides) that sizes and bitmaps allow."""
    for x, y, fit in _candidates(n, c, bits, side, percent):
        for p, q in zip(*np.nonzero(fit)):
            a, b = v[x[p]], v[y[q]]
            yield (a, b) if a < b else (b, a)


def _runs(batches: Batches) -> Iterator[tuple[int, int, list]]:
    """``key, part`` and the other columns of their rows, of rows that come in this order. One run is held at a time."""
    now, held = None, []
    for rows in batches:
        for key, part, *member in zip(*(c.to_pylist() for c in rows.columns)):
            if (key, part) != now:
                if held:
                    yield *now, held
                now, held = (key, part), []
            held.append(member)
    if held:
        yield *now, held


def tile_members(members: DataFrame, percent: int) -> DataFrame:
    """Members of a key that may link with one of another component there: sizes and bitmaps do not rule it out.

    ``members`` has ``key, part, v, n, c, bits, side``; returns all but ``bits``. A run is sorted by size and cut into tiles; a tile
    meets itself and the tiles after it as long as sizes allow. A run holds no more sets than two parts of a common shingle.
    """
    schema = pa.schema([("key", pa.int64()), ("part", pa.int32()), ("v", pa.binary()), ("n", pa.int32()), ("c", pa.binary()), ("side", pa.int32())])

    def run(batches: Batches) -> Batches:
        out: list[tuple] = []
        for key, part, held in _runs(batches):
            if len(held) < 2:
                continue
            v, n, c, bits, side = zip(*held)
            touched = np.zeros(len(held), bool)
            for x, y, fit in _candidates(n, c, bits, side, percent):
                touched[x[fit.any(axis=1)]] = True
                touched[y[fit.any(axis=0)]] = True
            out += [(key, part, v[i], n[i], c[i], side[i]) for i in np.flatnonzero(touched)]
            if len(out) >= PAIRS:
                yield batch(schema, list(zip(*out)))
                out = []
        if out:
            yield batch(schema, list(zip(*out)))

    rows = members.select("key", "part", "v", "n", "c", "bits", "side").repartition("key", "part").sortWithinPartitions("key", "part")
    return rows.mapInArrow(run, "key bigint, part int, v binary, n int, c binary, side int")


def _links(v: list, c: list, bits: list, side: list, sets: list[np.ndarray], percent: int) -> Iterator[tuple[bytes, bytes]]:
    """Links between members of different components, compared exactly, as many as it takes to connect what links connect."""
    label = np.unique(c, return_inverse=True)[1]
    for x, y, fit in _candidates([len(s) for s in sets], c, bits, side, percent):
        for i, may in zip(x, fit):
            others = y[may & (label[y] != label[i])]
            if not len(others):
                continue
            ends = np.cumsum([len(sets[j]) for j in others])
            found = np.isin(np.concatenate([sets[j] for j in others]), sets[i], kind="sort")
            both = np.diff(np.cumsum(found)[ends - 1], prepend=0)
            enough = 100 * both >= percent * (len(sets[i]) + np.diff(ends, prepend=0) - both)
            for j in others[enough]:
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    yield (v[i], v[j]) if v[i] < v[j] else (v[j], v[i])


def tile_links(touched: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` that connect all members of each key in ``touched`` (of :func:`tile_members`) that links connect.

    The set (``v, s``) of a member travels once for each key, and a key gives fewer links than it has members, however many pairs of
    them link. Pairs that are connected by then need no comparison; all others are compared. A run holds the sets of its members.
    """
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Batches) -> Batches:
        for _, _, held in _runs(batches):
            v, c, side, s = zip(*held)
            s = [np.frombuffer(x, np.uint64) for x in s]
            found = list(_links(v, c, [bitmap(x) for x in s], side, s, percent))
            if found:
                yield batch(schema, list(zip(*found)))

    rows = touched.join(sets.select("v", "s"), "v").select("key", "part", "v", "c", "side", "s")
    rows = rows.repartition("key", "part").sortWithinPartitions("key", "part")
    return rows.mapInArrow(run, "a binary, b binary").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``v, c`` of every end of ``edges`` (``a, b``): the smallest ``v`` that it is connected with.

    Labels spread to neighbours and to the label's own label until none changes; each round is written down.
    """
    both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("c")).select(
        "v", F.least("v", "c").alias("c")), "labels")
    while True:
        seen = both.join(labels.select(F.col("v").alias("b"), "c"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        jumped = labels.join(labels.select(F.col("v").alias("c"), F.col("c").alias("j")), "c")
        fresh = jumped.join(seen, "v").select("v", F.least("c", "j", "m").alias("c"), (F.least("j", "m") < F.col("c")).alias("moved"))
        fresh = materialize(fresh, "labels")
        labels = fresh.select("v", "c")
        if fresh.filter("moved").isEmpty():
            return labels


def jaccard_components(
    documents: DataFrame, words: int = WORDS, percent: int = PERCENT, hot: int = HOT
) -> DataFrame:
    """Connected near duplicates of ``documents`` (``doc_id, text``): ``doc_id, n_shingles, component_id``.

    A document's set holds its distinct shingles of ``words`` words (runs of characters other than space and the control characters 9
    to 13, A-Z in lower case); a shorter text is one shingle. Two documents link when their sets have at least ``percent`` of the union in
    common. ``component_id`` is the smallest doc_id that links lead to, the document's own included.

    Null, empty and wordless texts have an empty set and link with nothing, each other included. Rows are never merged: equal ids or
    texts give one row each, equal texts one component. A null doc_id stays null and is larger than all others. Other columns
    are not read. An empty table gives no rows. Shingles are compared by 64-bit hash, sets by 128-bit hash.

    No link between different components is lost: all sets of a key first meet its first set (one pair per member); where the sets of keys
    with the same first set are still in several components, all pairs across these are bounded by bitmaps in tiles of similar size, then
    compared exactly unless links connect them by then. Keys more common than ``hot`` are dealt over parts, and parts meet in pairs.
    """
    spark = documents.sparkSession
    bound(spark)
    found = materialize(document_sets(documents, words), "shingle-sets")
    rows = found.filter("sketch IS NULL").select("doc_id", "n_shingles", "v")
    signed = materialize(signatures(documents, _counts(found), words, percent, hot), "signatures")
    shared = materialize(shared_postings(_postings(signed)), "shared-postings")

    bits = signed.select("v", "n", "bits").join(shared.select("v").distinct(), "v", "left_semi")
    bits = materialize(bits.dropDuplicates(["v"]), "bitmaps")
    discard(signed)

    near = F.lit(100) * F.least("n", "pivot_n") >= F.lit(percent) * F.greatest("n", "pivot_n")
    heads = shared.filter("part >= 0").select("key", F.lit(-1).alias("part"), F.col("pivot").alias("v"), F.col("pivot_n").alias("n"))
    star = shared.unionByName(shared_postings(heads.distinct())).filter(near).filter("v <> pivot")
    pairs = star.select(F.least("v", "pivot").alias("a"), F.greatest("v", "pivot").alias("b")).distinct()
    pairs = materialize(pairs, "star-pairs")
    bounded = materialize(_bound(pairs, bits, percent), "bounded-pairs")
    sets = _sets_of(documents, rows, _ends(bounded), words)
    edges, labels = _connect(_fine(bounded, sets, percent), sets, None, None, ["b"], percent)
    discard(sets)

    members = lookup_join(_gathered(shared, hot), labels, ["v"]).withColumn("c", F.coalesce("c", "v"))
    members = materialize(members, "members")
    discard(shared)
    who = [F.bit_xor(F.xxhash64("v", F.lit(i))).alias(f"_who{i}") for i in (1, 2)]
    split = members.groupBy("key").agg(F.count("*").alias("_n"), F.min("c").alias("_low"), F.max("c").alias("_high"), *who)
    split = split.filter("_n > 2 AND _low < _high")  # a pair alone has met as pivot and member
    # A passage gives many keys with the same members (told by 128 bits of hash): one of them finds all their pairs.
    split = split.groupBy("_n", "_who1", "_who2").agg(F.min("key").alias("key")).select("key")
    members = members.join(split, "key", "left_semi").join(bits.select("v", "bits"), "v")
    rare = members.filter("part < 0").withColumn("side", F.lit(None).cast("int"))
    parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    common = members.filter("part >= 0").withColumn("side", F.col("part")).withColumn("_q", parts)
    common = common.withColumn("part", F.least("side", "_q") * PARTS + F.greatest("side", "_q")).withColumn(
        "side", F.when(F.col("side") != F.col("_q"), F.col("side")))
    alone = common.filter("side IS NULL").unionByName(rare.withColumn("_q", F.lit(0)))
    # A part that meets another has its sides marked; both rows of a pair of parts carry the same part number.
    crossing = common.filter("side IS NOT NULL")
    touched = tile_members(alone.drop("_q"), percent).unionByName(tile_members(crossing.drop("_q"), percent))
    touched = materialize(touched, "tile-members")
    discard(bits)
    if not touched.isEmpty():
        sets = _sets_of(documents, rows, touched.select("v"), words, ("v", "s"))
        more = materialize(tile_links(touched, sets, percent), "tile-pairs")
        discard(sets)
        if not more.isEmpty():
            labels = components(edges.unionByName(more))

    texts_of = rows.filter("v IS NOT NULL").groupBy("v").agg(F.min("doc_id").alias("_first"))
    texts_of = lookup_join(texts_of, labels, ["v"]).withColumn("c", F.coalesce("c", "v"))
    texts_of = materialize(texts_of, "classes")
    first = texts_of.join(labels.select("c").distinct(), "c", "left_semi").groupBy("c").agg(F.min("_first").alias("_least"))
    known = lookup_join(texts_of, materialize(first, "component-ids"), ["c"]).select(
        "v", F.coalesce("_least", "_first").alias("_component"))
    placed = lookup_join(rows, materialize(known, "set-components"), ["v"])
    kind = dict(documents.dtypes)["doc_id"]
    return placed.select(
        F.col("doc_id").cast(kind).alias("doc_id"), "n_shingles",
        F.coalesce("_component", "doc_id").cast(kind).alias("component_id"))


def _ends(pairs: DataFrame) -> DataFrame:
    """``v`` of both ends of all pairs."""
    return pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v")))


def _sets_of(documents: DataFrame, rows: DataFrame, wanted: DataFrame, words: int, columns: tuple[str, ...] = ("v", "f", "s")) -> DataFrame:
    """``v``, fingerprints ``f`` and shingles ``s`` of the sets in ``wanted``, made again from one text each; no other texts are looked at."""
    carriers = rows.join(wanted.distinct(), "v", "left_semi").groupBy("v").agg(F.min("doc_id").alias("_doc"))
    carriers = materialize(carriers.select("_doc").distinct(), "carriers")
    docs = documents.selectExpr("CAST(doc_id AS bigint) AS doc_id", "text")
    small = F.broadcast(carriers) if fits_broadcast(carriers) else carriers
    docs = docs.join(small, F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi")
    schema = pa.schema([("v", pa.binary()), ("f", pa.binary()), ("s", pa.binary())])

    def run(batches: Batches) -> Batches:
        for found in batches:
            for start in range(0, len(found), 100):
                made = list(_sets(found.slice(start, 100), words))
                yield batch(schema, [[v for v, _ in made], [fingerprints(s) for _, s in made], [s.tobytes() for _, s in made]])

    made = docs.mapInArrow(run, "v binary, f binary, s binary").select(*columns)
    return materialize(made.dropDuplicates(["v"]), "sets")


def fingerprints(s: np.ndarray) -> bytes:
    """Two bytes of each element: elements that two sets share have equal ones, others seldom."""
    return (s >> np.uint64(20)).astype(np.uint16).tobytes()


def _close(x: np.ndarray, y: np.ndarray, marks: np.ndarray, percent: int) -> bool:
    """Whether the fingerprints of two sets leave room for the threshold; ``marks`` has a false for each value and is left so."""
    most = min(len(x), len(y))
    for one, other in ((x, y), (y, x)):
        marks[one] = True
        most = min(most, int(np.count_nonzero(marks[other])))
        marks[one] = False
    return (100 + percent) * most >= percent * (len(x) + len(y))


def _fine(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose fingerprints leave room for the threshold; a quarter of the bytes of the sets moves for that."""
    left, right = (sets.select(F.col("v").alias(x), F.col("f").alias(f"{x}_f")) for x in "ab")

    def run(batches: Batches) -> Batches:
        marks = np.zeros(1 << 16, bool)
        for rows in batches:
            keep = []
            for x, y in zip(rows.column(2), rows.column(3)):
                x, y = (np.frombuffer(z.as_buffer(), np.uint16) for z in (x, y))
                keep.append(_close(x, y, marks, percent))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([rows.column(0).filter(keep), rows.column(1).filter(keep)], names=["a", "b"])

    met = pairs.join(left, "a").join(right, "b").select("a", "b", "a_f", "b_f")
    return materialize(met.mapInArrow(run, "a binary, b binary"), "fine-pairs")


def _connect(
    pairs: DataFrame, sets: DataFrame, edges: DataFrame | None, labels: DataFrame | None, group: list[str], percent: int
) -> tuple[DataFrame, DataFrame]:
    """Links among ``pairs`` that connect anything new, added to ``edges``, and the components they give.

    Round by round, four times as many pairs per ``group`` as before are compared exactly; pairs whose ends are connected by then
    need no comparison. All pairs across components are compared in the end.
    """
    many = 1
    while True:
        if labels is not None:
            for end in "ab":
                pairs = lookup_join(pairs, labels.select(F.col("v").alias(end), F.col("c").alias(f"_c{end}")), [end])
            pairs = pairs.withColumns({f"_c{end}": F.coalesce(f"_c{end}", end) for end in "ab"}).filter("_ca <> _cb")
            pairs = pairs.select("a", "b", F.least("_ca", "_cb").alias("_ca"), F.greatest("_ca", "_cb").alias("_cb"))
        rank = F.row_number().over(W.partitionBy(*group).orderBy("a", "b"))
        pairs = materialize(pairs.withColumn("_now", rank <= many), "pairs-to-do")
        now = pairs.filter("_now").select("a", "b")
        if labels is not None and now.isEmpty():
            return edges, labels
        links = materialize(_exact(now, sets, percent), "links")
        edges = links if edges is None else edges.unionByName(links)
        labels = components(edges)
        pairs, many = pairs.filter("NOT _now").select("a", "b"), 4 * many
