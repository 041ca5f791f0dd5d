"""Queries on vocabularies, word classes, n-gram models and their perplexity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions.predicates import WORD_CLASSES
from tidemark.operators import hooks, ngrams, perplexity, prompts, scores, snapshots, validation, vocabulary, wordclass
from tidemark.operators.ordinals import with_position
from tidemark.plans import continual, evaluate
from tidemark.plans.registry import query
from tidemark.plans.snapshot_queries import NOVEL
from tidemark.plans.text_queries import LONG_SCORES
from tidemark.session import discard, materialize, new_path
from tidemark.sources import tables

TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
TOKENS = f"regexp_extract_all({{}}, '{TOKEN}')"
DOC_TOKENS = TOKENS.replace("{}", "text")

# --- vocabulary ---

VOCABULARY = f"""
    counts AS (SELECT token, count(*) AS n FROM (SELECT unnest({DOC_TOKENS}) AS token FROM documents) GROUP BY token),
    vocabulary AS (
        SELECT token, row_number() OVER (ORDER BY n DESC, token) + 4 AS token_id, n FROM counts
        UNION ALL SELECT * FROM (VALUES ('</s>', 0, 0), ('<s>', 1, 0), ('<unk>', 2, 0), ('<pad>', 3, 0), ('<mask>', 4, 0)))"""


@query(f"WITH {VOCABULARY} SELECT token, token_id, n FROM vocabulary")
def build_vocabulary(t):
    return vocabulary.build_vocabulary(t.documents)


LENGTH = 512
# A vocabulary from the documents, used on the passages: some tokens are unknown.
ENCODED = f"""
    {VOCABULARY},
    cut AS (SELECT {{{{id}}}} AS id0, list_slice({DOC_TOKENS}, 1, {LENGTH}) AS tokens FROM {{{{table}}}}),
    flat AS (SELECT id0, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM cut),
    ids AS (SELECT id0, list(CAST(coalesce(v.token_id, 2) AS INTEGER) ORDER BY pos) AS ids
            FROM flat LEFT JOIN vocabulary v ON v.token = flat.token GROUP BY id0),
    real AS (SELECT cut.id0, coalesce(ids, []) AS ids FROM cut LEFT JOIN ids ON ids.id0 = cut.id0)"""


def encoded(table: str, key: str) -> str:
    return ENCODED.replace("{{table}}", table).replace("{{id}}", key)


def padded(side: str) -> str:
    fill = lambda value: f"list_transform(generate_series(1, {LENGTH} - len(ids)), lambda x: {value})"
    ones = "list_transform(ids, lambda x: 1)"
    parts = [(fill(3), "ids"), (fill(0), ones)] if side == "left" else [("ids", fill(3)), (ones, fill(0))]
    ids, mask = [f"array_to_string(list_concat({a}, {b}), ' ')" for a, b in parts]
    return f"{ids} AS input_ids, {mask} AS mask"


def as_text(df, *names):
    return df.withColumns({n: F.array_join(F.transform(n, lambda x: x.cast("string")), " ") for n in names})


@query(f"WITH {encoded('benchmark', 'item_id')} SELECT id0 AS item_id, {padded('left')} FROM real")
def encode_left(t):
    words = vocabulary.build_vocabulary(t.documents)
    return as_text(vocabulary.encode(t.benchmark, ["item_id"], words, LENGTH), "input_ids", "mask")


@query(f"WITH {encoded('documents', 'doc_id')} SELECT id0 AS doc_id, {padded('right')} FROM real")
def encode_right(t):
    words = vocabulary.build_vocabulary(t.documents)
    return as_text(vocabulary.encode(t.documents, ["doc_id"], words, LENGTH, pad_side="right"), "input_ids", "mask")


@query(f"WITH {encoded('benchmark', 'item_id')} SELECT id0 AS item_id, {padded('left')} FROM real")
def encode_shuffled(t):
    # As with a vocabulary that is too large to be broadcast.
    words = vocabulary.build_vocabulary(t.documents)
    return as_text(vocabulary.encode(t.benchmark, ["item_id"], words, LENGTH, broadcast_rows=0), "input_ids", "mask")


@query(
    f"""WITH tokens AS (SELECT doc_id, list_slice({DOC_TOKENS}, 1, {LENGTH}) AS x FROM documents)
        SELECT doc_id, array_to_string(x, ' ') AS text FROM tokens"""
)
def decode_encoded(t):
    words = vocabulary.build_vocabulary(t.documents)
    return vocabulary.decode(vocabulary.encode(t.documents, ["doc_id"], words, LENGTH), ["doc_id"], words)


def example_field(name: str, text: str, length: int) -> str:
    return f"SELECT subject, relation, '{name}' AS f, {text} AS said, {length} AS n FROM {{fact_curr}}"


QUESTION, WHOLE = "subject || ' ' || relation", "subject || ' ' || relation || ' ' || object"


@query(
    f"""WITH {VOCABULARY},
    asked AS ({example_field('source', QUESTION, 8)} UNION ALL {example_field('target', 'object', 3)}
              UNION ALL {example_field('label', WHOLE, 8)}),
    cut AS (SELECT *, list_slice({TOKENS.replace('{}', 'said')}, 1, n) AS tokens FROM asked),
    flat AS (SELECT subject, relation, f, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM cut),
    ids AS (SELECT subject, relation, f, list(CAST(coalesce(v.token_id, 2) AS INTEGER) ORDER BY pos) AS ids
            FROM flat LEFT JOIN vocabulary v ON v.token = flat.token GROUP BY ALL),
    filled AS (
        SELECT subject, relation, f, array_to_string(list_concat(list_transform(generate_series(1, n - len(ids)), lambda x: 3), ids), ' ') AS ids,
               array_to_string(list_concat(list_transform(generate_series(1, n - len(ids)), lambda x: 0), list_transform(ids, lambda x: 1)), ' ') AS mask
        FROM cut JOIN ids USING (subject, relation, f))
    SELECT subject, relation, s.ids AS source_ids, s.mask AS source_mask, t.ids AS target_ids, t.mask AS target_mask,
           l.ids AS label_ids, l.mask AS label_mask
    FROM filled s JOIN filled t USING (subject, relation) JOIN filled l USING (subject, relation)
    WHERE s.f = 'source' AND t.f = 'target' AND l.f = 'label'"""
)
def encode_examples(t):
    # A tuning example: the question, its answer and the whole fact as label, side by side.
    asked = prompts.fact_prompts(t.fact_curr, "finetune").drop("nonprompt")
    found = vocabulary.encode_examples(asked, ["subject", "relation"], vocabulary.build_vocabulary(t.documents), 8, 3)
    return as_text(found, *[f"{f}_{x}" for f in ("source", "target", "label") for x in ("ids", "mask")])


# --- word spans and classes ---

WORDS = f"""
    chunks AS (SELECT doc_id, regexp_extract_all(text || ' ', '[^ ]+ *') AS c FROM documents),
    words AS (SELECT doc_id, unnest(c) AS chunk, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS word_pos FROM chunks),
    pieces AS (SELECT doc_id, word_pos, rtrim(chunk, ' ') AS word,
                      len({TOKENS.replace('{}', "rtrim(chunk, ' ')")}) AS span,
                      greatest(length(chunk) - length(rtrim(chunk, ' ')) - 1, 0) AS extra FROM words),
    spans AS (SELECT doc_id, word_pos, word, span,
                     CAST(sum(span + extra) OVER (PARTITION BY doc_id ORDER BY word_pos) - span - extra AS INTEGER) AS start
              FROM pieces)"""


@query(
    f"""WITH {WORDS} SELECT doc_id, word_pos, word, start, CAST(start + span AS INTEGER) AS "end" FROM spans WHERE span > 0"""
)
def word_spans(t):
    return wordclass.word_spans(t.documents, ["doc_id"])


LEXICON_ROWS = ", ".join(f"('{word}', '{tag}')" for tag, words in wordclass.LEXICON.items() for word in words.split())
BARE = r"regexp_replace(word, '[^\p{L}\p{N}]', '', 'g')"
TAGGED = rf"""
    {WORDS},
    lexicon(word, tag) AS (VALUES {LEXICON_ROWS}),
    tagged AS (
        SELECT s.*, coalesce(x.tag,
            CASE WHEN {BARE.replace('word', 's.word')} = '' THEN 'SYM'
                 WHEN regexp_matches({BARE.replace('word', 's.word')}, '^[0-9]') THEN 'CD'
                 WHEN regexp_matches({BARE.replace('word', 's.word')}, '^\p{{Lu}}') AND word_pos > 0 THEN 'NNP'
                 WHEN ends_with({BARE.replace('word', 's.word')}, 'ing') THEN 'VBG'
                 WHEN ends_with({BARE.replace('word', 's.word')}, 'ed') THEN 'VBD'
                 WHEN ends_with({BARE.replace('word', 's.word')}, 'ly') THEN 'RB'
                 WHEN ends_with({BARE.replace('word', 's.word')}, 's') AND length({BARE.replace('word', 's.word')}) > 3 THEN 'NNS'
                 ELSE 'NN' END) AS tag
        FROM spans s LEFT JOIN lexicon x ON x.word = lower({BARE.replace('word', 's.word')})),
    classed AS (SELECT *, CASE WHEN tag IN ('NNP', 'NNPS') THEN 'ner' WHEN tag IN ('NN', 'NNS') THEN 'noun'
                               WHEN contains(tag, 'VB') THEN 'verb' WHEN contains(tag, 'CD') THEN 'num' END AS word_class
                FROM tagged)"""


@query(f"WITH {TAGGED} SELECT doc_id, tag, word_class, CAST(sum(span) AS BIGINT) AS tokens FROM classed WHERE span > 0 GROUP BY ALL")
def token_classes(t):
    classed = wordclass.classed_tokens(t.documents, ["doc_id"], wordclass.lexicon(t.spark)).filter("word is not null")
    return classed.groupBy("doc_id", "tag", "word_class").agg(F.count("*").alias("tokens"))


@query(
    f"""WITH {WORDS} SELECT doc_id, word_pos, span AS tokens FROM spans WHERE span > 0
        UNION ALL SELECT doc_id, NULL, CAST(sum(extra) AS BIGINT) FROM pieces GROUP BY doc_id HAVING sum(extra) > 0"""
)
def attached_spans(t):
    texts = wordclass.dealt_by(t.documents, ["doc_id"])
    tokens = wordclass.word_tokens(texts, ["doc_id"]).select("doc_id", "pos")
    spans = wordclass.word_spans(texts, ["doc_id"]).drop("word")
    found = wordclass.attach_spans(tokens, spans, ["doc_id"])
    return found.groupBy("doc_id", "word_pos").agg(F.count("*").alias("tokens"))


# --- n-gram models ---


def counts(source: str, name: str) -> str:
    """Bigram counts of the texts of ``source``."""
    return f"""
    {name}_t AS (SELECT {DOC_TOKENS} AS x FROM {source}),
    {name} AS (SELECT prev, token, count(*) AS n FROM (
                   SELECT unnest(x) AS token, unnest(list_concat(['<s>'], x[1:len(x) - 1])) AS prev FROM {name}_t)
               GROUP BY prev, token)"""


@query(f"WITH {counts('{snap_prev}', 'model')} SELECT prev, token, n FROM model")
def model_initial(t):
    return continual.initial(t.snap_prev)


# The texts that are new in the later snapshot: novel sentences of every page.
DIFF = NOVEL.strip().removeprefix("WITH") + """,
    diff AS (SELECT page_id, string_agg(sentence, ' ' ORDER BY pos) AS text FROM novel GROUP BY page_id)"""
MERGED = "SELECT prev, token, CAST(sum(n) AS BIGINT) AS n FROM ({}) GROUP BY prev, token"


def diff_texts(t):
    """The diff corpus, written down: training and mixing read it several times."""
    return materialize(snapshots.diff_corpus(t.snap_prev, t.snap_curr), "diff-corpus")


@query(
    f"WITH {counts('{snap_prev}', 'model')}, {DIFF}, {counts('diff', 'more')} "
    + MERGED.format("SELECT * FROM model UNION ALL SELECT * FROM more")
)
def model_subset(t):
    return continual.subset(continual.initial(t.snap_prev), diff_texts(t))


REPLAY = """
    replay AS (SELECT page_id, text FROM {snap_prev}
               QUALIFY row_number() OVER (ORDER BY md5('42:' || page_id)) <= (SELECT count(*) FROM diff))"""


@query(
    f"WITH {counts('{snap_prev}', 'model')}, {DIFF}, {REPLAY}, {counts('diff', 'more')}, {counts('replay', 'again')} "
    + MERGED.format("SELECT * FROM model UNION ALL SELECT * FROM more UNION ALL SELECT * FROM again")
)
def model_mix_review(t):
    return continual.mix_review(continual.initial(t.snap_prev), diff_texts(t), t.snap_prev, ["page_id"])


def losses(model: str, source: str, key: str) -> str:
    """Token losses of the texts of ``source`` under the counts named ``model``."""
    return f"""
    ctx AS (SELECT prev, sum(n) AS n_prev FROM {model} GROUP BY prev),
    uni AS (SELECT token, sum(n) AS n FROM {model} GROUP BY token),
    size AS (SELECT sum(n) + count(*) + 1 AS size FROM uni),
    texts AS (SELECT {key} AS id0, {DOC_TOKENS} AS x FROM {source}),
    asked AS (SELECT id0, unnest(x) AS token, unnest(list_concat(['<s>'], x[1:len(x) - 1])) AS prev,
                     CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS pos FROM texts),
    losses AS (SELECT id0, pos, asked.token, coalesce(-ln(b.n / n_prev), -ln(0.4 * (coalesce(u.n, 0) + 1) / size)) AS nll
               FROM asked CROSS JOIN size LEFT JOIN {model} b ON b.prev = asked.prev AND b.token = asked.token
               LEFT JOIN ctx ON ctx.prev = asked.prev LEFT JOIN uni u ON u.token = asked.token)"""


SCORED = f"WITH {counts('{snap_prev}', 'model')}, {losses('model', 'benchmark', 'item_id')}"


@query(f"{SCORED} SELECT id0 AS item_id, pos, token, round(nll, 4) AS nll FROM losses")
def score_tokens(t):
    model = ngrams.scorer(continual.initial(t.snap_prev))
    scored = ngrams.score_tokens(ngrams.bigram_rows(t.benchmark, ["item_id"]), model)
    return scored.select("item_id", "pos", "token", F.round("nll", 4).alias("nll"))


@query(f"{SCORED} SELECT id0 AS item_id, pos, token, round(nll, 4) AS nll FROM losses")
def score_tokens_shuffled(t):
    # As for a model that is too large to be broadcast.
    model = ngrams.scorer(continual.initial(t.snap_prev), broadcast_rows=0)
    scored = ngrams.score_tokens(ngrams.bigram_rows(t.benchmark, ["item_id"]), model, broadcast_rows=0)
    return scored.select("item_id", "pos", "token", F.round("nll", 4).alias("nll"))


@query(
    f"""{SCORED}, place AS (SELECT item_id, (row_number() OVER (ORDER BY item_id) - 1) // 4 AS batch_id FROM benchmark)
        SELECT round(exp(avg(loss)), 4) AS ppl FROM (
            SELECT batch_id, avg(nll) AS loss FROM losses JOIN place ON item_id = id0 GROUP BY batch_id)"""
)
def corpus_perplexity(t):
    model = ngrams.scorer(continual.initial(t.snap_prev))
    scored = ngrams.score_corpus(t.positioned("benchmark"), "position", model, 4)
    return perplexity.perplexity(scored).select(F.round("ppl", 4).alias("ppl"))


BY_CLASS = ", ".join(f"avg(CASE WHEN word_class = '{c}' THEN nll END) AS {c}" for c in WORD_CLASSES)


@query(
    f"""WITH {counts('{snap_prev}', 'model')}, {TAGGED},
    parts AS (SELECT doc_id, word_pos, word_class, {TOKENS.replace('{}', 'word')} AS x FROM classed),
    pieces0 AS (SELECT doc_id, word_pos, word_class, unnest(x) AS token, generate_subscripts(x, 1) AS k FROM parts),
    row_asked AS (SELECT doc_id // 4 AS batch_id, word_class, token,
                         lag(token, 1, '<s>') OVER (PARTITION BY doc_id ORDER BY word_pos, k) AS prev FROM pieces0),
    ctx AS (SELECT prev, sum(n) AS n_prev FROM model GROUP BY prev),
    uni AS (SELECT token, sum(n) AS n FROM model GROUP BY token),
    size AS (SELECT sum(n) + count(*) + 1 AS size FROM uni),
    losses AS (SELECT batch_id, word_class, coalesce(-ln(b.n / n_prev), -ln(0.4 * (coalesce(u.n, 0) + 1) / size)) AS nll
               FROM row_asked a CROSS JOIN size LEFT JOIN model b ON b.prev = a.prev AND b.token = a.token
               LEFT JOIN ctx ON ctx.prev = a.prev LEFT JOIN uni u ON u.token = a.token)
    SELECT {", ".join(f'round(exp(avg("{c}")), 4) AS "{c}"' for c in ["all", *WORD_CLASSES])}
    FROM (SELECT batch_id, avg(nll) AS "all", {BY_CLASS} FROM losses GROUP BY batch_id)"""
)
def corpus_perplexity_by_class(t):
    model = ngrams.scorer(continual.initial(t.snap_prev))
    result = evaluate.corpus_perplexity(t.positioned("documents"), "position", model, wordclass.lexicon(t.spark), 4)
    return result.select(*[F.round(c, 4).alias(c) for c in result.columns])


PROBE_SPLITS = """
    probes AS (
        SELECT c.subject || ' ' || c.relation || ' ' || c.object AS text, c.subject, c.relation,
               CASE WHEN p.subject IS NOT NULL THEN 'unchanged' ELSE 'changed' END AS split
        FROM {fact_curr} c LEFT JOIN {fact_prev} p
            ON p.subject = c.subject AND p.relation = c.relation AND p.object = c.object),
    placed AS (SELECT *, (row_number() OVER (PARTITION BY split ORDER BY subject, relation) - 1) // 32 AS batch_id FROM probes),
    known AS (SELECT subject || ' ' || relation || ' ' || object AS text FROM {fact_prev})"""


@query(
    f"""WITH {PROBE_SPLITS}, {counts('known', 'model')}, {losses('model', 'placed', "split || ':' || batch_id")}
        SELECT split, round(exp(avg(loss)), 4) AS ppl FROM (
            SELECT split_part(id0, ':', 1) AS split, id0, avg(nll) AS loss FROM losses GROUP BY ALL) GROUP BY split"""
)
def probe_perplexity(t):
    known = prompts.fact_prompts(t.fact_prev, "evaluate_ppl").select(F.col("input").alias("text"))
    model = ngrams.scorer(continual.initial(known))
    probes = snapshots.fact_diff(t.fact_prev, t.fact_curr)
    result = evaluate.probe_perplexity(probes, ["subject", "relation"], model, 32, "split")
    return result.select("split", F.round("ppl", 4).alias("ppl"))


GRID_PAGES = DIFF + """,
    pages AS (SELECT c.page_id, c.text, CASE WHEN p.page_id IS NULL OR p.text <> c.text THEN 'changed' ELSE 'unchanged' END AS split
             FROM {snap_curr} c LEFT JOIN {snap_prev} p ON p.page_id = c.page_id),
    placed AS (SELECT *, (row_number() OVER (PARTITION BY split ORDER BY page_id) - 1) // 4 AS batch_id FROM pages)"""


def grid_part(method: str, counts_sql: str) -> str:
    return f"""SELECT '{method}' AS method, * FROM (WITH {counts_sql}, {losses('model', 'placed', "split || ':' || batch_id")}
        SELECT split, round(exp(avg(loss)), 4) AS ppl FROM (
            SELECT split_part(id0, ':', 1) AS split, id0, avg(nll) AS loss FROM losses GROUP BY ALL) GROUP BY split)"""


@query(
    f"WITH {GRID_PAGES} "
    + grid_part("initial", counts("{snap_prev}", "model"))
    + " UNION ALL "
    + grid_part("brute_force", counts("{snap_curr}", "model"))
    + " UNION ALL "
    + grid_part(
        "subset",
        counts("(SELECT text FROM {snap_prev} UNION ALL SELECT text FROM diff)", "model"),
    )
)
def perplexity_grid(t):
    prev, curr = materialize(t.snap_prev, "prev-pages"), materialize(t.snap_curr, "curr-pages")
    diff = snapshots.page_diff(prev, curr)
    kind = F.when(F.col("status") == "unchanged", "unchanged").otherwise("changed").alias("split")
    texts = curr.join(diff.select("page_id", kind), "page_id")
    more = materialize(snapshots.diff_corpus(prev, curr), "diff-corpus")
    grid = continual.perplexity_grid([(prev, ["initial", "subset"]), (curr, ["brute_force"]), (more, ["subset"])], texts, "page_id", 4)
    for table in (prev, curr, more):
        discard(table)
    return grid.select("method", "split", F.round("ppl", 4).alias("ppl"))


TOLD = "told AS (SELECT subject || ' ' || relation || ' ' || object AS text FROM {fact_curr})"
STEPS = ["SELECT text FROM {snap_prev}", "SELECT text FROM diff", "SELECT text FROM told"]


@query(
    f"WITH {GRID_PAGES}, {TOLD} SELECT 'diff' AS run_id, split, CAST(method AS BIGINT) AS step, ppl FROM ("
    + " UNION ALL ".join(grid_part(str(n), counts(f"({' UNION ALL '.join(STEPS[:n])})", "model")) for n in (1, 2, 3)) + ")"
)
def validation_while_training(t):
    # Changed and unchanged pages are validated after each of three steps: the earlier snapshot, the diff, the facts.
    diff = snapshots.page_diff(t.snap_prev, t.snap_curr)
    kind = F.when(F.col("status") == "unchanged", "unchanged").otherwise("changed").alias("split")
    texts = t.snap_curr.join(diff.select("page_id", kind), "page_id").select("split", "page_id", "text")
    folder, log = new_path(t.spark, "validation"), new_path(t.spark, "metrics")
    validation.start(with_position(texts, ["page_id"], ["split"]), "position", 4, folder)
    told = prompts.fact_prompts(t.fact_curr, "evaluate_ppl").select(F.col("input").alias("text"))
    for step, learnt in enumerate([t.snap_prev, diff_texts(t), told], 1):
        found = validation.advance(t.spark, folder, step, ngrams.train(learnt))
        tables.log_metrics(validation.validation_metrics(found, "diff"), log)
    report = tables.metric_report(t.spark.read.parquet(log), ["ppl"])
    return report.select("run_id", "split", "step", F.round("ppl", 4).alias("ppl"))


PASSAGES = "SELECT item_id, rtrim(text, '.') AS text FROM benchmark"
QUESTIONS = "SELECT subject, relation, subject || ' ' || relation AS text FROM {fact_curr}"
BEAM_STEP = """
    s{i} AS (
        SELECT last, tail, path, nll, done FROM (
            SELECT last, coalesce(t.token, tail) AS tail,
                   CASE WHEN t.token IS NULL THEN path ELSE list_append(path, t.token) END AS path,
                   nll + coalesce(t.loss, 0) AS nll, (t.token IS NULL OR t.token = '.') AS done
            FROM s{p} LEFT JOIN best t ON t.prev = tail WHERE NOT s{p}.done
            UNION ALL SELECT last, tail, path, nll, done FROM s{p} WHERE done)
        QUALIFY row_number() OVER (PARTITION BY last ORDER BY round(nll, 9), array_to_string(path, ' ')) <= 2)"""


def beams_sql(asked: str, key: str) -> str:
    """The two best completions of four steps for the prompts of ``asked`` under the counts named model."""
    return f"""
    ctx AS (SELECT prev, sum(n) AS n_prev FROM model GROUP BY prev),
    best AS (SELECT m.prev, m.token, -ln(m.n / n_prev) AS loss FROM model m JOIN ctx USING (prev)
             QUALIFY row_number() OVER (PARTITION BY m.prev ORDER BY m.n DESC, m.token) <= 2),
    asked AS (SELECT {key}, coalesce(list_last({DOC_TOKENS}), '<s>') AS last FROM ({asked})),
    s0 AS (SELECT DISTINCT last, last AS tail, CAST([] AS VARCHAR[]) AS path, CAST(0 AS DOUBLE) AS nll, false AS done FROM asked),
    {",".join(BEAM_STEP.format(i=i, p=i - 1) for i in range(1, 5))},
    ranked AS (SELECT last, array_to_string(path, ' ') AS completion, nll,
                      row_number() OVER (PARTITION BY last ORDER BY round(nll, 9), array_to_string(path, ' ')) AS rank FROM s4)
    SELECT {key}, CAST(rank AS INTEGER) AS rank, completion, round(nll, 4) AS nll FROM asked JOIN ranked USING (last)"""


@query(f"WITH {counts('{snap_prev}', 'model')}, {beams_sql(PASSAGES, 'item_id')}")
def complete_passages(t):
    # Each whole passage without its closing full stop is a prompt.
    model = ngrams.scorer(continual.initial(t.snap_prev))
    asked = t.benchmark.select("item_id", F.rtrim("text", F.lit(".")).alias("input"))
    return ngrams.complete(asked, ["item_id"], model, steps=4).withColumn("nll", F.round("nll", 4))


@query(
    f"""WITH known AS (SELECT subject || ' ' || relation || ' ' || object AS text FROM {{fact_prev}}),
    {counts('known', 'model')}, {beams_sql(QUESTIONS, 'subject, relation')}"""
)
def complete_probes(t):
    # A third of all prompts and more end in the same word.
    known = prompts.fact_prompts(t.fact_prev, "evaluate_ppl").select(F.col("input").alias("text"))
    model = ngrams.scorer(continual.initial(known))
    asked = prompts.fact_prompts(t.fact_curr, "evaluate")
    return ngrams.complete(asked, ["subject", "relation"], model, steps=4).withColumn("nll", F.round("nll", 4))


# --- a model of one's own ---


def length_losses(batches):
    """Stand-in for a user's model: a token costs a tenth of its length."""
    for rows in batches:
        yield pd.DataFrame({
            "example_id": rows["item_id"], "pos": rows["pos"], "token_id": rows["token"].str.len(),
            "nll": rows["token"].str.len() / 10,
        })


@query(
    f"""SELECT round(exp(avg(loss)), 6) AS ppl FROM (
            SELECT item_id, avg(length(token) / 10) AS loss
            FROM (SELECT item_id, unnest({DOC_TOKENS}) AS token FROM benchmark) GROUP BY item_id)"""
)
def score_with_model(t):
    scored = hooks.score_with(ngrams.bigram_rows(t.benchmark, ["item_id"]), length_losses)
    return perplexity.perplexity(scored, batch="example_id").select(F.round("ppl", 6).alias("ppl"))


def lower_predictions(batches):
    """Stand-in for a user's model: it says its prompt again in lower case."""
    for rows in batches:
        yield pd.DataFrame({"example_id": rows["example_id"], "prediction": rows["input"].str.lower()})


@query(LONG_SCORES + " SELECT example_id, em, round(CAST(f1 AS DOUBLE), 6) AS f1 FROM scored")
def predict_with_model(t):
    asked = t.text_pairs.select("example_id", F.col("prediction").alias("input"))
    said = hooks.score_with(asked, lower_predictions, hooks.PREDICTIONS)
    pairs = scores.match_predictions(said, t.text_pairs.select("example_id", "target"), ["example_id"])
    return scores.score_answers(pairs, ["example_id"]).select("example_id", "em", F.round("f1", 6).alias("f1"))
