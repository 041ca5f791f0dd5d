"""Tokens, packing, toxicity, page extraction and the pipeline on small tables."""

from __future__ import annotations

import os
import random
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import bpe, html, packing, toxicity

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab eths'\n\t0=-é漢😀\xa0"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_bpe_like_the_library(codec, tik, text):
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == tik.encode_ordinary(text)
    assert "".join(codec.decode(ids[i:i + 4] for i in range(0, len(ids), 4))) == text  # characters cut by every chunk


def test_bpe_of_long_pieces(codec, tik, monkeypatch):
    draw = random.Random(0)
    long = [" " * 9_000, "a" * 9_000, "".join(draw.choice("abcdeinrst") for _ in range(9_000)), "=-" * 4_000]
    for flush in (4_096, 200):
        monkeypatch.setattr(bpe, "FLUSH", flush)
        monkeypatch.setattr(bpe, "MAX_PAIRS", 50)
        for text in long:
            assert np.frombuffer(codec.encode(text), "<u4").tolist() == tik.encode_ordinary(text)


def test_bpe_documents(spark, docs, tik):
    rows = [(1, "Hello <|endoftext|> world"), (1, "x"), (2, None), (3, ""), (4, "é" * 50_000), (None, "a")]
    encoded = bpe.encode_documents(docs(rows), RANKS, public_tokenizers.PATTERN)
    found = bpe.decode_documents(encoded, RANKS, public_tokenizers.PATTERN).collect()
    got = sorted((repr(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist(), r["text"]) for r in found)
    assert got == sorted((repr(i), tik.encode_ordinary(t or ""), t or "") for i, t in rows)
    assert bpe.encode_documents(docs([]), RANKS, public_tokenizers.PATTERN).count() == 0


@lru_cache(1)
def library():
    tokenizer = Tokenizer.from_file(WORDS)
    return tokenizer


def library_ids(text):
    return library().encode(text, add_special_tokens=False).ids


def test_words_like_the_library():
    draw = random.Random(3)
    words = packing.Words(WORDS)
    alphabet = "abAB 'sS\t\n\x0b\x0c\r\x1c\x1d\x85\xa0̧́é ​　ΣσςİÉüẞ12漢😀<|endoftext|>.,"
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 25))) for _ in range(500)] + ["Hello, World. it's", "ΑΣ ας", "x" * 5_000]
    texts += ["hello <|endoftext|> world", "a<|startoftext|>b.<|endoftext|>", "<|ENDOFTEXT|> <|endoftext|"]
    got = [np.frombuffer(x, "<u4").tolist() for x in words.encode(texts)]
    assert got == [library_ids(t) for t in texts]


def check_packing(rows, found):
    """Every token once, sequences gapless and within bounds; the share of padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc, text in rows:
        ids, at = library_ids(text or "") + [1], 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at:at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.LENGTH
        total += packing.LENGTH
        padding += packing.LENGTH - at if at & (at - 1) else 0
    return padding / max(1, total)


def test_packing(spark, docs):
    draw = random.Random(6)
    rows = [(i, "word " * draw.choice([0, 1, 7, 300, 1_500, 2_047, 2_048, 5_000, draw.randint(1, 3_000)])) for i in range(150)]
    rows += [(1_000, None), (1_001, "")]
    packed = packing.pack_documents(docs(rows).repartition(3), WORDS)
    assert check_packing(rows, packed.collect()) < 0.06  # a hundred sequences, the last ones part full
    ids = packing.sequence_ids(docs(rows), packed, WORDS).groupBy("sequence_id").agg(F.sum(F.octet_length("ids") / 4).alias("n")).collect()
    assert sum(r["n"] for r in ids) == sum(len(library_ids(t or "")) + 1 for _, t in rows)
    assert packing.pack_documents(docs([]), WORDS).count() == 0
    twice = packing.pack_documents(docs([(1, "a b"), (1, "a b"), (1, "c")]), WORDS).collect()
    assert len(twice) == 3 and len({(r["sequence_id"], r["offset"]) for r in twice}) == 3


def test_linear_program():
    """Patterns cover the demand exactly and cost no more than the best known ones."""
    demand = np.zeros(100)
    demand[[26, 33, 39]] = 70, 90, 50
    patterns, used = packing.solve_program(demand, 100, 1e-9)
    assert np.allclose(patterns @ used, demand) and used.sum() <= 76.25 + 1e-6
    assert all((p * np.arange(1, 101)).sum() <= 100 for p in patterns.T)
    rng = np.random.default_rng(0)
    for _ in range(20):
        demand = rng.integers(0, 30, 64) * rng.integers(0, 2, 64)
        plan = packing.plan_patterns(demand, 64)
        assert (sum((p * c for p, c in plan), np.zeros(64, int)) == demand).all()
        assert all((p * np.arange(1, 65)).sum() <= 64 and c > 0 for p, c in plan)
        assert sum(c for _, c in plan) <= packing.solve_program(demand.astype(float), 64)[1].sum() + np.count_nonzero(demand)
    prices = rng.random(20)
    best, pattern = packing.best_pattern(prices, 37)
    table = [0.0] * 38
    for c in range(1, 38):
        table[c] = max([table[c - 1], *[table[c - i - 1] + prices[i] for i in range(min(c, 20))]])
    assert np.isclose(best, table[37]) and np.isclose(prices @ pattern, best)


def toxic_corpus():
    draw = random.Random(8)
    say = lambda: " ".join("".join(draw.choice("aeiounrst") for _ in range(draw.randint(2, 6))) for _ in range(draw.randint(4, 12)))
    rows, labels = [], []
    for i in range(400):
        parts = [say() for _ in range(draw.randint(1, 12))]
        bad = i % 4 == 0
        if bad:
            parts.insert(draw.randrange(len(parts) + 1), f"{say()} {draw.choice(['zonk', 'vrumply'])} {say()}")
        rows.append((i, ". ".join(parts) + "."))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity(spark, docs):
    rows, labels = toxic_corpus()
    table = spark.createDataFrame([(i, 1, y) for i, y in labels] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    edge = [(9_000, None), (9_001, ""), (9_002, "... !"), (9_003, "calm words here. " * 9_000), (9_004, "such a Zonk you are"), (9_004, "fine")]
    found = toxicity.detect_toxicity(docs(rows + edge), table).collect()
    assert len(found) == len(rows) + len(edge)
    truth = dict(labels)
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    located = [r for r in found if r["predicted"]]
    assert all("zonk" in r["sentence_text"].lower() or "vrumply" in r["sentence_text"] for r in located)
    by = defaultdict(list)
    for r in found:
        by[r["doc_id"]].append(r["predicted"])
    assert [by[i] for i in (9_000, 9_001, 9_002, 9_003)] == [[0]] * 4 and sorted(by[9_004]) == [0, 1]
    assert toxicity.detect_toxicity(docs([]), table).count() == 0
    assert {r["predicted"] for r in toxicity.detect_toxicity(docs(rows[:3]), table.limit(0)).collect()} == {0}


def test_toxicity_is_learnt_in_a_task(spark, docs, monkeypatch):
    """The driver neither trains nor sees the texts; the model is that of the sample's rows."""
    rows = [(i, f"plain words number {i}. " + ("a vile grumblefoo here." if i % 2 else "a kind remark here.")) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    expected = toxicity.train(toxicity.training_rows(docs(rows), labels))
    assert expected

    here, train = os.getpid(), toxicity.train

    def elsewhere(found):
        assert os.getpid() != here
        return train(found)

    monkeypatch.setattr(toxicity, "train", elsewhere)
    assert toxicity.learn(docs(rows), labels) == expected
    assert toxicity.learn(docs(rows), labels.limit(0)) == toxicity.learn(docs([]), labels) == {}
    found = toxicity.detect_toxicity(docs(rows), labels)
    assert {r["doc_id"] % 2: r["predicted"] for r in found.collect()} == {0: 0, 1: 1}


def test_toxicity_never_learns_from_held_out_rows(spark, docs):
    rows, labels = toxic_corpus()
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    models = [toxicity.train(toxicity.training_rows(docs(rows), spark.createDataFrame(x, "doc_id long, toxic int"))) for x in (labels, flipped)]
    assert models[0] == models[1] and models[0]


PAGES = [
    ("<html><body><header><h1>Site</h1></header><nav>a b</nav><article><h1>T &amp; U</h1><div class='notice'>we use</div><p>Body <i>t</i>ext.<br>on"
     "</p><form>name</form><section class='comments'><p>c1</p></section></article><aside>side</aside></body></html>", "T & U\nBody text. on"),
    ("<body><div id=main><h1>A</h1><p>One\n  two<p>Three<script>var x='</p>';</script><style>p{}</style><div class=ads>buy</div></div><footer>f</footer>", "A\nOne two\nThree"),
    ("<article><p>x</p><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><!-- <p>no</p> --></article>", "x\na\nb\nc\nd"),
    ("plain &lt;text&gt;\n only", "plain <text> only"), ("", ""), (None, ""), ("<div><p></p> \n</div>", ""), ("<p>a<b", "a<b"),
    ("<article><p>" + "w " * 60_000 + "</p></article>", ("w " * 60_000).strip()),
]


def test_pages(spark):
    table = spark.createDataFrame([(i % 8, f"u{i}", page, "x") for i, (page, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    found = html.extract_pages(table).collect()
    assert sorted((r["url"], r["text"]) for r in found) == sorted((f"u{i}", text) for i, (_, text) in enumerate(PAGES))
    assert html.extract_pages(table.limit(0)).count() == 0


def test_pages_of_unknown_words():
    say = "This is a paragraph with enough words in it to be read as part of the article itself."
    links = "<ul><li><a href=/a>one</a></li><li><a href=/b>two</a></li></ul>"
    three = f"<p>{say}</p>" * 3
    found = "\n".join([say] * 3)
    assert html.main_text(f"<body><div>{links}</div><div><h1>T</h1><p>{say}</p><p>{say}</p></div></body>") == f"T\n{say}\n{say}"
    for word in ("gutter", "texto", "fusszeile"):
        assert html.main_text(f"<body><div class={word}>{three}</div></body>") == found
        assert html.main_text(f"<body><nav>{links}</nav><div class={word}>{three}</div><footer>c</footer></body>") == found
        assert html.main_text(f"<body><div class=gutter>{links}</div><div class={word}>{three}</div><div class=imprint>{links}</div></body>") == found
    loose = f"<body><nav>{links}</nav><p>{say}</p><p>{say}</p><div class=ad>{say}</div><p>{say}</p><footer><p>{say}</p></footer></body>"
    assert html.main_text(loose) == found


def test_marginals_by_enumeration():
    """Sum-product gives the same marginals as adding up all labellings of a small tree."""
    model = html.trained()
    tree = html.parse("<body><nav>a</nav><article><p>b c</p><div class=ad>d</div></article>")
    own, n = [model.potential(f) for f in tree.feature], len(tree.parent)
    total, content = 0.0, np.zeros(n)
    for bits in range(1 << n):
        y = [bits >> i & 1 for i in range(n)]
        weight = html.ROOT[y[0]] * own[0][y[0]]
        for i in range(1, n):
            weight *= own[i][2][y[tree.parent[i]]][y[i]] * own[i][y[i]]
        total += weight
        content += weight * np.array(y)
    assert np.allclose(model.marginals(tree), content / total)


@pytest.mark.parametrize("bare, least", [(0.0, 0.98), (0.4, 0.95)])  # articles and lists whose elements say nothing are harder
def test_held_out_pages(monkeypatch, bare, least):
    model, real = html.trained(), random.Random
    monkeypatch.setattr(html, "BARE", bare)
    monkeypatch.setattr(html.random, "Random", lambda seed: real(99))
    right = wrong = 0
    for page in html.training_pages(200):
        tree = html.parse(page, labelled=True)
        whole = int("y=0" not in page)
        for text, label, p in zip(tree.text, tree.label, model.marginals(tree)):
            if text:
                right += (whole if label is None else label) == (p > html.LIKELY)
                wrong += (whole if label is None else label) != (p > html.LIKELY)
    assert right / (right + wrong) > least


def test_rows_of_one_id_go_for_their_own_texts(spark, docs):
    draw = random.Random(2)
    a, b = (" ".join(f"w{draw.randint(0, 99)}" for _ in range(60)) for _ in "ab")
    given = docs([(3, b), (5, a), (5, b), (7, a), (8, ""), (8, ""), (9, None)])
    left = corpus_pipeline.one_of_each(spark, given, "")
    assert left.columns == given.columns
    assert sorted((r["doc_id"], repr(r["text"])) for r in left.collect()) == sorted(
        (i, repr(t)) for i, t in [(3, b), (5, a), (8, ""), (8, ""), (9, None)])


def test_training_texts_are_drawn_from_all_over(spark, docs, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 200_000)
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    text = "".join(f"Sentence number {n} is here. " for n in range(2_000))
    rows = toxicity.training_rows(docs([(ids[0], text), (ids[1], "short")]), spark.createDataFrame([(i, 1) for i in ids], "doc_id long, toxic int"))
    long = max((t for t, _ in rows), key=len)
    assert {t for t, _ in rows} == {"short", long} and len(long) < 3_000
    numbers = [int(s.split()[2]) for s in toxicity.sentences_of(long)]
    assert min(numbers) < 500 and max(numbers) > 1_500


def test_pipeline(spark, docs, tmp_path):
    rows, labels = toxic_corpus()
    draw = random.Random(9)
    say = lambda n: " ".join("".join(draw.choice("aeiounrstl") for _ in range(draw.randint(2, 8))) for _ in range(n))
    rows = [(i, f"{t} {say(80)}") for i, t in rows]
    copy = say(200)
    rows += [(5_000, copy), (5_001, copy), (5_002, copy + " more"), (5_002, copy + " more"), (6_000, None), (6_001, ""), (6_002, "spam " * 300), (None, say(99))]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    table, kept = docs(rows), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = table.columns
        table = stage(spark, table, str(tmp_path))
        assert table.columns == columns
        path = str(tmp_path / f"stage{len(kept)}")
        table.write.parquet(path)
        table = spark.read.parquet(path)
        kept.append(sorted(r["doc_id"] for r in table.collect()))
    clean = {i for i, y in labels if not y}
    assert set(kept[0]) == {i for i, _ in labels} | {5_000, 5_001, 5_002}
    assert clean | {5_000, 5_001, 5_002} <= set(kept[1]) and len(set(kept[1]) - clean) <= 5
    assert kept[2] == sorted((set(kept[1]) - {5_001, 5_002}))
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {i: t for i, t in rows if i in set(kept[2])}
    assert {r["doc_id"] for r in final} == set(texts)
    check_packing([(i, t) for i, t in texts.items()][:20], [r for r in final])
    empty = spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty_out = stage(spark, empty, str(tmp_path))
        assert empty_out.count() == 0


def test_pages_keep_what_is_no_script():
    shown = [
        ("<p>a</p><svg class='i'/><p>b</p>", "a\nb"), ("<p>a<svg class=i/> b</p>", "a b"), ("<p>a <svg><text>x</text></svg>b</p>", "a b"),
        ("<p>a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b</p>", "a x=1 b"), ("<p>a</p><noscript>n</noscript><p>b</p>", "a\nn\nb"),
        ("<p>a</p><object><p>o</p></object>", "a\no"), ("<p>a</p><xmp>x</xmp>", "a\nx"),
        ("<title-block>t</title-block><p>a</p>", "t\na"), ("<video-player>v</video-player><p>a</p>", "v\na"), ("<p>a<script >b</script ></p>", "a"),
    ]
    assert [html.main_text(f"<article>{page}</article>") for page, _ in shown] == [text for _, text in shown]
