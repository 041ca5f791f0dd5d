"""Tokenizer alignment, vector codes and decontamination against brute force on small tables."""

from __future__ import annotations

import random
import re

import numpy as np
import public_tokenizers
import pytest

from tests.conftest import rows as sorted_rows
from tidemark.llm import alignment, decontamination, vector_codes

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# --- alignment ---


@pytest.fixture(scope="module")
def sides():
    return alignment.tokens_of(BYTE), alignment.tokens_of(PIECE)


def by_hand(text, a, b):
    """Groups, pairs of ids of overlapping tokens and number of A tokens by byte ranges, with the libraries alone."""
    if not text:
        return None
    sides = [(a, a.library.encode(" " + text, add_special_tokens=False).ids), (b, b.library.encode(text))]
    ranges, data = [], []
    for side, ids in sides:
        at, found = 0, []
        for i in ids:
            found.append((at, at + len(side.bytes[i]), i))
            at += len(side.bytes[i])
        ranges.append(found)
        data.append(b"".join(side.bytes[i] for i in ids))
    if data != [(" " + text).encode()] * 2:
        return None
    x, y = ranges
    groups, start = [], 0
    for cut in sorted({e for _, e, _ in x} & {e for _, e, _ in y}):
        groups.append("|".join(",".join(str(i) for s, _, i in side if start <= s < cut) for side in ranges))
        start = cut
    pairs = sorted(i * alignment.SHIFT + j for s, e, i in x for u, v, j in y if s < v and u < e)
    return ";".join(groups), pairs, len(x)


def odd_texts():
    draw = random.Random(1)
    letters = "abcdeinrst ABC  \n\t.,' \xe9\xf1漢字\U0001f600▁<s>́\x1c\x85"
    out = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 40))) for _ in range(400)]
    parts = ["the", " ", "\n", "  ", "\xe9", "<|endoftext|>", "</s>", "<0x41>", "word", "123", " 's", "ing"]
    out += ["".join(draw.choice(parts) for _ in range(draw.randint(0, 20))) for _ in range(400)]
    return out + [f"{chr(c)} x{chr(c)}{chr(c)} {chr(c)}" for c in range(0x530)]


def test_alignment_of_odd_texts(sides, monkeypatch):
    monkeypatch.setattr(alignment, "MAX_WORDS", 500)
    both, texts = alignment.Aligner(*sides), odd_texts()
    for at in range(0, len(texts), 300):
        for text, found in zip(texts[at:at + 300], both.align(texts[at:at + 300])):
            got = found and (found[0], sorted(np.frombuffer(found[1], np.int64).tolist()), found[2])
            assert got == by_hand(text, *sides), repr(text)


def test_pointers_reach_the_last_token():
    draw = np.random.default_rng(3)
    for size in (1, 2, 30, 500):
        cuts = [np.append(np.unique(draw.integers(1, 3 * size + 1, size)), 3 * size + 1) for _ in "ab"]
        last = alignment.last_tokens(*cuts)
        ends = np.concatenate(cuts)
        shared = np.intersect1d(*cuts)
        assert (ends[last] == shared[np.searchsorted(shared, ends)]).all() and (last < len(cuts[0])).all()


def test_alignment_of_documents(spark, docs, sides):
    rows = [(1, "Hello, world"), (1, "Hello, world"), (2, None), (3, ""), (4, "▁ bytes differ"), (5, "one " * 1_500),
            (6, "a漢" * 500), (None, "Hello there"), (7, "  ")]
    told = [by_hand(t, *sides) or ("", [], 0) for _, t in rows]
    n = {}
    for _, pairs, _ in told:
        for p in set(pairs):
            n[p] = n.get(p, 0) + 1
    most = {}
    for p, k in n.items():
        most[p // alignment.SHIFT] = max(k, most.get(p // alignment.SHIFT, 0))
    want = []
    for (i, _), (groups, pairs, n_a) in zip(rows, told):
        n_groups = groups.count(";") + 1 if groups else 0
        best = sum(n[p] == most[p // alignment.SHIFT] for p in pairs)
        want.append((i, n_a, len(pairs) + n_groups - n_a, n_groups, len(pairs), best, sum(n[p] for p in pairs), groups))
    found = alignment.align_corpus(docs(rows), BYTE, PIECE)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert sorted_rows(found, *names) == sorted(want, key=repr)
    assert alignment.align_corpus(docs([]), BYTE, PIECE).count() == 0


# --- vector codes ---


def vectors(spark, rows):
    schema = "vec_id long, embedding array<float>, label int, code string, x int, _label string"
    return spark.createDataFrame([(i, v, y, "c", 1, "z") for i, v, y in rows], schema)


def codes_by_hand(rows, rounds=6):
    kept = [(i, np.floor(4096 * np.array(v, float)).astype(np.int64).reshape(8, -1), y) for i, v, y in rows
            if v and all(c is not None and np.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1].astype("<i4").tobytes()))
    x = np.array([v for _, v, _ in kept])
    books = x[:16].transpose(1, 0, 2).copy()
    nearest = lambda: np.array([((x[:, p, None] - books[p][None]) ** 2).sum(-1) for p in range(8)])
    for _ in range(rounds):
        code = nearest().argmin(2)
        for p in range(8):
            for e in range(books.shape[1]):
                if (code[p] == e).any():
                    books[p, e] = x[code[p] == e, p].sum(0) // (code[p] == e).sum()
    d = nearest()
    error = d.min(2).sum(0).tolist()
    label = {}
    for (_, _, y), e in zip(kept, error):
        label[y] = label.get(y, 0) + e
    return [(i, bytes(c), e, label[y]) for (i, _, y), c, e in zip(kept, d.argmin(2).T.astype(np.uint8), error)], books


def clouds(n):
    draw = np.random.default_rng(7)
    middles = draw.normal(0, 0.3, (20, 16))
    rows = [(int(i), [float(np.float32(c)) for c in middles[draw.integers(20)] + draw.normal(0, 0.05, 16)], int(draw.integers(3)))
            for i in draw.permutation(n)]
    same = [0.25] * 16
    return rows + [(n + k, same, None) for k in range(200)] + [
        (3, same, 1), (None, same, 2), (n + 300, None, 1), (n + 301, [], 1), (n + 302, [0.1] * 15 + [None], 1),
        (n + 303, [0.1] * 15 + [float("nan")], 1), (n + 304, [0.1] * 15 + [float("-inf")], 1)]


@pytest.mark.parametrize("worn", [0.0, 0.5, 1.0])
def test_vector_codes(spark, monkeypatch, worn):
    monkeypatch.setattr(vector_codes, "WORN", worn)
    rows = clouds(2_000)
    found, books = vector_codes.compress_vectors(vectors(spark, rows))
    want, want_books = codes_by_hand(rows)
    got = [(r["vec_id"], bytes(r["codes"]), r["error"], r["label_error"]) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and (books == want_books).all()


def test_bounds_save_comparisons(spark):
    shares = vector_codes.learn_codes(vectors(spark, clouds(2_000)))[2]
    assert shares[0] == 1 and shares[-1] < 0.5


def test_few_and_no_vectors(spark):
    rows = [(i, [0.1 * i] * 8, 1) for i in range(5)]
    found, books = vector_codes.compress_vectors(vectors(spark, rows))
    assert books.shape == (8, 5, 1) and {r["error"] for r in found.collect()} == {0}
    again = vector_codes.decompress_vectors(found, books).collect()
    assert all(abs(c - 0.1 * r["vec_id"]) < 1 / 4096 for r in again for c in r["embedding"])
    assert vector_codes.compress_vectors(vectors(spark, [(1, None, 1)]))[0].count() == 0
    assert vector_codes.compress_vectors(vectors(spark, []))[0].count() == 0


def test_net_moves_are_at_most_the_moves_added_up():
    draw = np.random.default_rng(2)
    history = [draw.integers(-50, 50, (2, 4, 3)) for _ in range(4)]
    net = vector_codes.net_moves(history)
    for t in range(4):
        added = sum(np.sqrt(vector_codes.squared(a, b)) for a, b in zip(history[t + 1:], history[t:]))
        for p in range(2):
            for c in range(4):
                others = [e for e in range(4) if e != c]
                true = max(np.sqrt(((history[-1][p, e] - history[t][p, e]) ** 2).sum()) for e in others)
                assert true <= net[t, p, c] <= true * 1.001
                assert t == 3 or net[t, p, c] <= max(added[p][e] for e in others) * 1.001


# --- decontamination ---

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def leaks_by_hand(docs, items, n):
    windows = {}
    for item, text in items:
        said = words_of(text)
        size = min(n, len(said))
        for i in range(len(said) - size + 1 if said else 0):
            windows.setdefault(tuple(said[i:i + size]), set()).add(item)
    out = []
    for doc, text in docs:
        said, hit, names = words_of(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(said) - size + 1):
                found = windows.get(tuple(said[i:i + size]))
                if found:
                    hit.update(range(i, i + size))
                    names |= found
        out.append((doc, len(said), len(hit), sorted(map(str, names - {None}))))
    return out


@pytest.fixture
def tests_of(spark):
    return lambda rows: spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "item_id long, text string, n_words int, _found string")


def leaky():
    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)] + ["\xe9t\xe9", "漢字", "7"]
    say = lambda k: [draw.choice(vocabulary) for _ in range(k)]
    passages = [say(draw.choice([1, 3, 5, 6, 12, 40])) for _ in range(30)]
    passages[0] = ["only"]
    items = [(i, " ".join(p)) for i, p in enumerate(passages)] + [(3, "Again, 3!"), (90, None), (91, ""), (92, "?!"), (None, "nobody owns this one")]
    items += [(93, " ".join(passages[5])), (200, " ".join(["hot"] * 7))]
    docs = [(1, None), (1, ""), (2, ".,;"), (2, "ONLY \x00 this"), (None, "nobody-OWNS\nthis one"), (4, "hot " * 20_000)]
    for i in range(10, 150):
        text = say(draw.randint(0, 30))
        for p in draw.sample(passages, draw.randint(0, 2)):
            k = draw.randint(1, len(p))
            text += p[:k] if draw.random() < 0.5 else p
            text += say(draw.randint(0, 5))
        docs.append((i, draw.choice([" ", ", ", "\n", " - "]).join(w.upper() if draw.random() < 0.3 else w for w in text)))
    return docs, items


@pytest.mark.parametrize("size", [1 << 20, 700])
def test_leaks(docs, tests_of, monkeypatch, size):
    monkeypatch.setattr(decontamination, "SEGMENT", 7)
    texts, items = leaky()
    found = decontamination.find_leaks(docs(texts), tests_of(items), 5, size)
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(leaks_by_hand(texts, items, 5), key=repr)
    for r in found.collect():
        spans = [(s["first"], s["last"]) for s in r["spans"]]
        assert sum(b - a + 1 for a, b in spans) == r["n_hit"] and all(x[1] + 1 < y[0] for x, y in zip(spans, spans[1:]))


@pytest.mark.parametrize("size", [1 << 20, 700])
def test_leaks_are_removed(docs, tests_of, size):
    texts, items = leaky()
    table = docs(texts)
    clean = {r[0] for r in leaks_by_hand(texts, items, 5) if not r[2]}
    whole = decontamination.remove_leaks(table, tests_of(items), True, 5, size)
    assert whole.columns == table.columns and {r["doc_id"] for r in whole.collect()} == clean
    cut = decontamination.remove_leaks(table, tests_of(items), False, 5, size)
    assert cut.columns == table.columns and cut.count() == len(texts)
    left = {(r["doc_id"], len(words_of(r["text"]))) for r in cut.collect()}
    assert left == {(i, n - hit) for i, n, hit, _ in leaks_by_hand(texts, items, 5)}
    assert decontamination.cut_words("A b, \xe9 c! D", [{"first": 1, "last": 2}]) == "A  c! D"


def test_leaks_of_empty_tables(docs, tests_of):
    assert decontamination.find_leaks(docs([]), tests_of([(1, "a b")])).count() == 0
    found = decontamination.find_leaks(docs([(1, "a b")]), tests_of([])).collect()
    assert [(r["n_words"], r["n_hit"], r["items"], r["spans"]) for r in found] == [(2, 0, [], [])]
