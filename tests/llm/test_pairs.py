"""N-gram join, exact search and archives against brute force on small tables."""

from __future__ import annotations

import base64
import hashlib
import random
import re

import numpy as np
import pytest

from tidemark.llm import ngram_join, topk, warc
from tidemark.session import new_path


def shingles(text, words=5):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    found = [w for w in re.split("[\x20\x09-\x0d]+", lower) if w]
    return frozenset(tuple(found[i:i + words]) for i in range(max(1, len(found) - words + 1))) if found else frozenset()


def components(rows):
    """(doc_id, number of shingles, smallest doc_id reachable) of each row, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                label[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), doc), doc)
    return sorted((doc, len(sets[i]), least[top(i)]) for i, (doc, _) in enumerate(rows))


def near_copies():
    draw = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    say = lambda n: [draw.choice(words) for _ in range(n)]
    rows = [None, "", " \n\x0b", "one two", "One  TWO", "one two three", "a b c d e", "a b c d e f", "é\xa0x \x85 y"]
    passage = say(60)
    for k in range(40):
        base = say(draw.choice([4, 12, 40, 150]))
        for _ in range(draw.randint(1, 6)):
            text = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // 25))):
                text[draw.randrange(len(text))] = draw.choice(words)
            rows.append(" ".join(text))
        rows.append(" ".join(base[: len(base) // 2] + passage))
        rows.append(" ".join(passage + say(draw.randint(0, 20))))
    base = say(100)
    for _ in range(60):  # one large group around a text, some of it out of reach of each other
        text = list(base)
        for _ in range(draw.randint(0, 4)):
            text[draw.randrange(100)] = draw.choice(words)
        rows.append(" ".join(text))
    rows += [" ".join(say(9_000))] * 3
    draw.shuffle(rows)
    return [(7 * i % 1_009, t) for i, t in enumerate(rows)] + [(3, rows[40]), (3, rows[41])]


@pytest.mark.parametrize("hot", [ngram_join.HOT, 8])
def test_components(docs, hot):
    rows = near_copies()
    found = ngram_join.jaccard_components(docs(rows).repartition(5), hot=hot)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, found.collect())) == components(rows)


def test_components_of_little(docs):
    assert ngram_join.jaccard_components(docs([])).count() == 0
    rows = [(5, None), (5, "a"), (4, "a"), (4, ""), (None, "a b")]
    got = sorted(map(repr, map(tuple, ngram_join.jaccard_components(docs(rows)).collect())))
    assert got == sorted(map(repr, [(5, 0, 5), (5, 1, 4), (4, 1, 4), (4, 0, 4), (None, 1, None)]))


def test_groups_near_the_threshold_write_few_pairs(spark, docs, monkeypatch):
    """A hundred texts of which no two reach the threshold by little: bitmaps rule out over half of the 4,950 pairs."""
    draw = random.Random(8)
    words = [f"w{i}" for i in range(3_000)]
    base = [draw.choice(words) for _ in range(400)]

    def changed(k):
        text = list(base)
        for at in draw.sample(range(400), k):
            text[at] = draw.choice(words)
        return " ".join(text)

    rows = [(i, changed(5)) for i in range(100)]
    wrote = []
    real = ngram_join.materialize
    monkeypatch.setattr(ngram_join, "materialize", lambda df, label: (found := real(df, label), wrote.append((label, found)))[0])
    found = ngram_join.jaccard_components(docs(rows))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()) == components(rows)
    assert max(df.count() for label, df in wrote if label == "tile-pairs") < 2_475


def test_groups_at_the_threshold_write_rows_by_member(spark, docs, monkeypatch):
    """A hundred and twenty texts around the threshold, 7,140 pairs: what the join writes of them goes with the texts."""
    draw = random.Random(9)
    words = [f"w{i}" for i in range(3_000)]
    base = [draw.choice(words) for _ in range(400)]

    def changed(k):
        text = list(base)
        for at in draw.sample(range(400), k):
            text[at] = draw.choice(words)
        return " ".join(text)

    rows = [(i, changed(draw.choice([4, 5, 5, 6]))) for i in range(120)]
    wrote = []
    real = ngram_join.materialize
    monkeypatch.setattr(ngram_join, "materialize", lambda df, label: (found := real(df, label), wrote.append((label, found.count())))[0])
    found = ngram_join.jaccard_components(docs(rows))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()) == components(rows)
    assert sum(n for label, n in wrote if label == "tile-pairs") < 120


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(0)
    for _ in range(300):
        pool = rng.integers(0, 2**63, 400).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(2))
        common = len(np.intersect1d(a, b))
        assert ngram_join.most_common(ngram_join.bitmap(a), ngram_join.bitmap(b), len(a) + len(b)) >= common


def test_tiles_find_what_pairs_find():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, rng.integers(20, 60))) for _ in range(40)]
    members = [[bytes([i]), len(s), bytes([i % 3]), ngram_join.bitmap(s), None] for i, s in enumerate(sets)]
    small = {p for i in range(40) for j in range(i) for p in ngram_join._cross(*zip(members[i], members[j]), 80)}
    assert set(ngram_join._cross(*zip(*members), 80)) >= small
    old, ngram_join.TILE = ngram_join.TILE, 7
    assert set(ngram_join._cross(*zip(*members), 80)) >= {
        (bytes([min(i, j)]), bytes([max(i, j)])) for i in range(40) for j in range(i) if i % 3 != j % 3
        and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    ngram_join.TILE = old


def best(rows, every, k):
    out = []
    vectors = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ints = [[int(np.floor(256 * x)) for x in v] for _, v in vectors]
    for q, (i, _) in enumerate(vectors):
        if i % every == 0:
            scores = [(-sum(a * b for a, b in zip(ints[q], ints[c])), j) for c, (j, _) in enumerate(vectors) if c != q and len(ints[c]) == len(ints[q])]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("pivots", [1, 8])
def test_top_k(spark, pivots):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6) * rng.choice([0.1, 1])]) for i in range(900)]
    rows += [(900 + i, [0.5] * 6) for i in range(300)]  # one vector over and over
    rows += [(10, rows[3][1]), (None, [1.0] * 6), (2000, None), (2010, [1.0, None]), (2020, [float("nan")] * 6), (2030, [float("inf")] * 6)]
    rows += [(2040, [1.0, 2.0]), (2041, [3.0, -1.0]), (2050, []), (2051, []), (2060, [1e6] * 6), (2070, [1.0] * 9)]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, size string").repartition(4)
    found = topk.top_k(table, every=10, k=5, pivots=pivots, sample=200)
    assert sorted(map(tuple, found.collect())) == best(rows, 10, 5)
    assert topk.top_k(table.limit(0), 10, 5).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>"), 10, 5).count() == 0


@pytest.mark.parametrize("least", [0, 4])
def test_archive(spark, least):
    html = ["<p>a</p>", "", None, "<p>a</p>", "é" * 70_000, "abc", "abc", "<p>a</p>", "x\r\n\r\ny", "é" * 70_000, "abc"]
    rows = [(i, f"http://h/{i}" if i % 3 else None, t) for i, t in enumerate(html)] + [(7, "http://h/7", "<p>a</p>"), (8, "evil\r\nWARC-Type: x", "z" * 9)]
    pages = spark.createDataFrame([(*r, "s", 1) for r in rows], "page_id long, url string, html string, sha256 string, _row int").repartition(3)
    path = new_path(spark, "warc-test")
    warc.write_archive(pages, path, least)
    records = warc.read_archive(spark, path).withColumn("record", warc.record_bytes()).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    expected, taken = [], set()
    for i, _, t in rows:
        t = t or ""
        first = max(j for j, _, o in rows if (o or "") == t)
        own = len(t.encode()) < least or i == first and t not in taken
        if own and len(t.encode()) >= least:
            taken.add(t)
        expected.append((i, len(t.encode()), digest(t), "response" if own else "revisit", None if own else first))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in records]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == len({t or "" for _, _, t in rows if len((t or "").encode()) >= least})
    for r in records:
        head, rest = bytes(r["record"]).split(b"\r\n\r\n", 1)
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert len(rest) == int(fields["Content-Length"]) + 4 and rest.endswith(b"\r\n\r\n") and fields["WARC-Type"] == r["record_type"]
        if r["record_type"] == "response":
            assert digest(rest[:-4].split(b"\r\n\r\n", 1)[1].decode()) == r["payload_digest"] == fields["WARC-Payload-Digest"][5:]
    assert warc.read_archive(spark, path).count() == len(rows)


def test_empty_archive(spark):
    path = new_path(spark, "warc-empty")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archive(spark, path).count() == 0
