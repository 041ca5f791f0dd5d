"""Vocabulary, encoding, word classes and n-gram models against brute force."""

import math
import re
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tidemark.operators import ngrams, ordinals, perplexity, validation, vocabulary, wordclass
from tidemark.plans import continual, evaluate, token_queries
from tidemark.session import materialize

TEXTS = [
    "The cat sat on the mat.", "The cat ran. The dog sat!", "", "dog dog dog dog dog dog", "A mat, a cat and 3 dogs.",
    "the " * 30 + "end.", "  odd   blanks here ",
]
TRAIN = TEXTS[:5]


def split(text):
    return re.findall(r"[^\W_]+|[^\w\s]|_", text)


def pairs(text):
    tokens = split(text)
    return list(zip(["<s>", *tokens], tokens))


@pytest.fixture(scope="module")
def corpus(spark):
    return materialize(spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string"), "corpus")


@pytest.fixture(scope="module")
def words(spark, corpus):
    return materialize(vocabulary.build_vocabulary(corpus.filter("id < 5")), "vocabulary")


def test_vocabulary(words):
    counts = Counter(t for x in TRAIN for t in split(x))
    expected = [*vocabulary.RESERVED, *sorted(counts, key=lambda t: (-counts[t], t))]
    assert [r["token"] for r in words.orderBy("token_id").collect()] == expected
    assert [r["token_id"] for r in words.orderBy("token_id").collect()] == list(range(len(expected)))


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
@pytest.mark.parametrize("side", ["left", "right"])
def test_encode_decode(corpus, words, side, broadcast_rows):
    ids = {r["token"]: r["token_id"] for r in words.collect()}
    found = vocabulary.encode(corpus, ["id"], words, 6, pad_side=side, broadcast_rows=broadcast_rows)
    expected = []
    for i, text in enumerate(TEXTS):
        real = [ids.get(t, vocabulary.UNKNOWN) for t in split(text)][:6]
        fill = 6 - len(real)
        sequence = [vocabulary.PAD] * fill + real if side == "left" else real + [vocabulary.PAD] * fill
        mask = [0] * fill + [1] * len(real) if side == "left" else [1] * len(real) + [0] * fill
        expected.append((i, sequence, mask))
    assert rows(found) == expected
    decoded = vocabulary.decode(found, ["id"], words, broadcast_rows=broadcast_rows)
    known = [" ".join(t for t in split(x)[:6] if t in ids) for x in TEXTS]
    assert rows(decoded) == list(enumerate(known))


def test_encode_examples(spark, words):
    prompts = spark.createDataFrame(
        [(1, "The cat", "mat", None), (2, "", "dog unknown", "The cat mat")], "id int, input string, target string, label string"
    )
    one, two = vocabulary.encode_examples(prompts, ["id"], words, 3, 2).orderBy("id").collect()
    assert one["label_ids"] is None and one["label_mask"] is None
    assert one["source_mask"] == [0, 1, 1] and len(one["target_ids"]) == 2 and one["target_mask"] == [0, 1]
    assert two["source_ids"] == [vocabulary.PAD] * 3 and two["target_ids"][1] == vocabulary.UNKNOWN
    assert two["label_mask"] == [1, 1, 1]


def test_word_spans(corpus):
    spans = {}
    for r in wordclass.word_spans(corpus, ["id"]).collect():
        spans.setdefault(r["id"], {})[r["word_pos"]] = (r["start"], r["end"], r["word"])
    assert spans[0] == {0: (0, 1, "The"), 1: (1, 2, "cat"), 2: (2, 3, "sat"), 3: (3, 4, "on"), 4: (4, 5, "the"), 5: (5, 7, "mat.")}
    assert spans[6] == {0: (0, 1, "odd"), 1: (3, 4, "blanks"), 2: (4, 5, "here")}
    assert 2 not in spans


def test_attach_spans_agrees(spark, corpus):
    tokens = wordclass.word_tokens(corpus, ["id"])
    attached = wordclass.attach_spans(tokens.select("id", "pos"), wordclass.word_spans(corpus, ["id"]), ["id"])
    assert rows(attached, "id", "pos", "word") == rows(tokens, "id", "pos", "word")


def test_attached_spans_move_texts_and_no_tokens(spark):
    texts = [(1, "The cat  sat."), (1, "a dog"), (None, "no id"), (2, ""), (3, None), (4, "mat. " * 50)]
    t = SimpleNamespace(documents=spark.createDataFrame(texts, "doc_id long, text string"))
    found = token_queries.attached_spans(t)
    # Two texts of one id meet each other's spans; without an id there is no span.
    assert sorted(map(tuple, found.filter("doc_id < 4 or doc_id is null").collect()), key=repr) == [
        (1, 0, 4), (1, 1, 4), (1, 2, 2), (1, None, 1), (None, None, 2)]
    assert found.filter("doc_id = 4").agg(F.sum("tokens")).first()[0] == 101
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = token_queries.attached_spans(t)._jdf.queryExecution().sparkPlan().toString()
        whole = token_queries.attached_spans(t)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and whole.count("Exchange") == 2 and "REPARTITION_BY_NUM" in whole


def test_word_classes(spark):
    df = spark.createDataFrame([(1, "The Paris mayor is running 3 times, and Tom jumped.")], "id int, text string")
    found = wordclass.classed_tokens(df, ["id"], wordclass.lexicon(spark)).orderBy("pos").collect()
    assert [(r["token"], r["word_class"]) for r in found] == [
        ("The", None), ("Paris", "ner"), ("mayor", "noun"), ("is", "verb"), ("running", "verb"), ("3", "num"), ("times", "noun"),
        (",", "noun"), ("and", None), ("Tom", "ner"), ("jumped", "verb"), (".", "verb"),
    ]


def test_own_tagger(spark):
    df = spark.createDataFrame([("x", 0)], "word string, word_pos int")
    tagged = wordclass.tag_words(df, wordclass.lexicon(spark), by_shape=lambda word, pos: F.lit("CD"))
    assert tagged.first()["tag"] == "CD"


def brute_loss(train, backoff=ngrams.BACKOFF):
    bigrams = Counter(p for x in train for p in pairs(x))
    before = Counter()
    for (prev, _), n in bigrams.items():
        before[prev] += n
    single = Counter(t for x in train for t in split(x))
    size = sum(single.values()) + len(single) + 1

    def loss(prev, token):
        if bigrams[prev, token]:
            return -math.log(bigrams[prev, token] / before[prev])
        return -math.log(backoff * (single[token] + 1) / size)

    return loss


@pytest.mark.parametrize("broadcast_rows", [0, 1_000_000])
def test_score_tokens(corpus, broadcast_rows):
    model = ngrams.scorer(ngrams.train(corpus.filter("id < 5")), broadcast_rows=broadcast_rows)
    loss = brute_loss(TRAIN)
    asked = ngrams.bigram_rows(corpus, ["id"])
    found = ngrams.score_tokens(asked, model, sample=asked.sample(0.3, 5), broadcast_rows=broadcast_rows)
    expected = sorted((i, p, t, round(loss(v, t), 9)) for i, x in enumerate(TEXTS) for p, (v, t) in enumerate(pairs(x)))
    assert sorted((r["id"], r["pos"], r["token"], round(r["nll"], 9)) for r in found.collect()) == expected


def test_tokens_are_made_once_and_shuffled_twice_at_most(spark, corpus, capsys, monkeypatch):
    model = ngrams.scorer(ngrams.train(corpus.filter("id < 5")))
    made = []
    keep = ngrams.materialize
    monkeypatch.setattr(ngrams, "materialize", lambda df, label: (df.explain(), made.append(label), keep(df, label))[2])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ngrams.score_tokens(ngrams.bigram_rows(corpus, ["id"]), model, broadcast_rows=0)
        found.explain()
        plan = capsys.readouterr().out
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Generate posexplode") == 1 and made[0] == "tokens"
    loss = brute_loss(TRAIN)
    expected = sorted((i, p, t, round(loss(v, t), 9)) for i, x in enumerate(TEXTS) for p, (v, t) in enumerate(pairs(x)))
    assert sorted((r["id"], r["pos"], r["token"], round(r["nll"], 9)) for r in found.collect()) == expected


def test_saved_scorer_is_not_shuffled_again(spark, corpus, tmp_path, capsys):
    model = ngrams.scorer(ngrams.train(corpus.filter("id < 5")))
    saved = ngrams.save_scorer(model, "kept", str(tmp_path / "kept"), 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = ngrams.bigram_rows(corpus, ["id"])
        found = ngrams.score_tokens(asked, saved, sample=asked.sample(0.3, 5), broadcast_rows=0)
        found.explain()
        lines = capsys.readouterr().out.splitlines()
        scans = [i for i, line in enumerate(lines) if "FileScan" in line and "Bucketed: true" in line]
        assert scans
        for i in scans:  # up to the join above it the table is sorted at most
            above = lines[max(j for j in range(i) if "Join" in lines[j]):i]
            assert not any("Exchange" in line and line.index("Exchange") >= lines[i].index("FileScan") - 12 for line in above[-3:])
        assert rows(found, "id", "pos", "nll") == rows(ngrams.score_tokens(asked, model), "id", "pos", "nll")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE kept_pairs")
        spark.sql("DROP TABLE kept_tokens")


def test_merge_is_training_on_both(corpus):
    first, more = corpus.filter("id < 3"), corpus.filter("id >= 3")
    assert rows(continual.subset(ngrams.train(first), more)) == rows(ngrams.train(corpus))


def test_probabilities_of_a_context_sum_to_one(corpus):
    model = ngrams.scorer(ngrams.train(corpus))
    sums = model.pairs.groupBy("prev").agg(F.sum(F.exp(-F.col("pair_nll"))).alias("p")).collect()
    assert all(r["p"] == pytest.approx(1) for r in sums)


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_complete(spark, corpus, broadcast_rows):
    model = ngrams.scorer(ngrams.train(corpus.filter("id < 5")))
    prompts = spark.createDataFrame([(1, "I saw The"), (2, "unseen"), (3, ""), (4, "mat")], "id int, input string")
    found = ngrams.complete(prompts, ["id"], model, steps=3, broadcast_rows=broadcast_rows).collect()
    best = {}
    for r in found:
        best.setdefault(r["id"], []).append((r["rank"], r["completion"], round(r["nll"], 6)))
    loss = brute_loss(TRAIN)
    path_loss = lambda path: round(sum(loss(a, b) for a, b in zip(path, path[1:])), 6)
    assert sorted(best[1])[0][2] == path_loss(["The", *sorted(best[1])[0][1].split()])
    assert best[2] == [(1, "", 0.0)], "nothing follows an unseen token"
    assert sorted(best[4])[0] == (1, ", a cat", path_loss(["mat", ",", "a", "cat"]))
    assert sorted(best[4])[1] == (2, ".", path_loss(["mat", "."]))
    assert len(best[3]) == 2


def test_corpus_perplexity(spark, corpus):
    placed = corpus.withColumnRenamed("id", "position")
    model = ngrams.scorer(ngrams.train(corpus.filter("id < 5")))
    row = evaluate.corpus_perplexity(placed, "position", model, wordclass.lexicon(spark), 2).first()
    loss, means = brute_loss(TRAIN), []
    for start in range(0, len(TEXTS), 2):
        batch = [loss(v, t) for x in TEXTS[start:start + 2] for v, t in pairs(x)]
        means.append(sum(batch) / len(batch))
    assert row["all"] == pytest.approx(math.exp(sum(means) / len(means)))


def test_perplexity_grid_writes_no_tokens(spark, monkeypatch):
    """Every method and split equals scoring each token, a null split included, and what is written down are texts and batches."""
    texts = [("changed", i, x) for i, x in enumerate([*TEXTS, None])] + [(None, 9, "The cat sat."), ("empty", 10, "")]
    checked = spark.createDataFrame(texts, "split string, id int, text string")
    first, more = (spark.createDataFrame([(x,) for x in part], "text string") for part in (TEXTS[:3], TEXTS[3:5]))
    placed = continual.with_position(checked, ["id"], ["split"])
    expected = set()
    for method, model in (("a", ngrams.train(first)), ("b", ngrams.merge(ngrams.train(first), ngrams.train(more)))):
        scored = ngrams.score_corpus(placed, "position", ngrams.scorer(model), 2, by=["split"])
        expected |= {(method, r["split"], round(r["ppl"], 9)) for r in perplexity.perplexity(scored, ["split"]).collect()}
    written = []
    for module in (ngrams, validation, ordinals):
        monkeypatch.setattr(module, "materialize", lambda df, label: written.append(label) or materialize(df, label))
    found = continual.perplexity_grid([(first, ["a", "b"]), (more, ["b"])], checked, "id", 2)
    assert {(r["method"], r["split"], round(r["ppl"], 9)) for r in found.collect()} == expected and len(expected) == 4
    assert written == ["positions", "batch-sizes"]
    assert continual.perplexity_grid([(first, ["a"])], checked.limit(0), "id", 2).count() == 0


def test_decode_makes_its_sequences_once(spark, words):
    """Also where the vocabulary is too large for a broadcast and the tokens are read several times."""
    made = spark.sparkContext.accumulator(0)

    def sequence(i):
        made.add(1)
        return [vocabulary.PAD, 5 + i % 3, 6]

    given = spark.range(20).select("id", F.udf(sequence, "array<int>")("id").alias("input_ids"))
    found = vocabulary.decode(given, ["id"], words, broadcast_rows=0)
    token = {r["token_id"]: r["token"] for r in words.collect()}
    assert rows(found) == sorted(((i, f"{token[5 + i % 3]} {token[6]}") for i in range(20)), key=repr)
    assert made.value == 20


def test_training_deals_many_texts_over_more_tasks(spark, monkeypatch):
    """Counts stay the same; texts beyond TASK_TEXT a core go to tasks of about that size."""
    texts = [(f"a{i} b a{i} b . c{i % 3} " * 200,) for i in range(40)] + [(None,), ("",), ("same text",), ("same text",)]
    corpus = spark.createDataFrame(texts, "text string").coalesce(1)
    expected = rows(ngrams.train(corpus))
    assert ngrams.dealt(corpus, "text", ngrams.TASK_TEXT).rdd.getNumPartitions() == 1
    size = sum(len(t or "") for t, in texts)
    assert ngrams.dealt(corpus, "text", size // 30).rdd.getNumPartitions() in (30, 31)
    monkeypatch.setattr(ngrams, "TASK_TEXT", size // 30)
    assert rows(ngrams.train(corpus)) == expected and expected
    empty = spark.createDataFrame([], "text string")
    assert rows(ngrams.train(empty)) == []


def test_a_grid_counts_equal_texts_once_and_keeps_nothing_else(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(continual, "materialize", lambda df, label: kept.setdefault(label, materialize(df, label)))
    first = spark.createDataFrame([("a b",), ("a b",), ("b a",), (None,)], "text string")
    checked = spark.createDataFrame([("x", 1, "a b"), ("y", 2, "a b"), (None, 3, "c")], "split string, id long, text string")
    found = continual.perplexity_grid([(first, ["m"]), (first, ["n"])], checked, "id", 2)
    texts = {r["_text"]: (r["_n0"], r["_n1"]) for r in kept["grid-texts"].collect()}
    assert texts == {"a b": (2, 2), "b a": (1, 1), None: (1, 1), "c": (0, 0)} and kept["grid-texts"].count() == 4
    assert {(r["method"], r["split"]) for r in found.collect()} == {(m, s) for m in "mn" for s in ("x", "y", None)}


def test_a_corpus_meets_the_model_by_pair(spark, monkeypatch):
    model = ngrams.scorer(ngrams.train(spark.createDataFrame([(t,) for t in TRAIN], "text string")))
    placed = spark.createDataFrame([(i, t) for i, t in enumerate(["the cat " * 40, "the cat sat", None, "Unheard 7"])], "position long, text string")
    sizes, loss = [], ngrams.weighted_loss
    monkeypatch.setattr(ngrams, "weighted_loss", lambda rows, *a: sizes.append(rows.count()) or loss(rows, *a))
    got = evaluate.corpus_perplexity(placed, "position", model, wordclass.lexicon(spark), 2).first()
    assert sizes == [6]
    want = perplexity.class_perplexity(evaluate.corpus_class_losses(placed, "position", model, wordclass.lexicon(spark), 2)).first()
    assert got.asDict() == {k: v if v is None else pytest.approx(v) for k, v in want.asDict().items()}
