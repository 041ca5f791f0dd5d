"""Queries on prompts, text clean-up, arrays and answer scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import arrays as A
from tidemark.functions import predicates as P
from tidemark.functions import text as T
from tidemark.operators import prompts, scores
from tidemark.operators.ordinals import batch_of, with_position
from tidemark.plans import evaluate
from tidemark.plans.registry import query

FACT_COLUMNS = "subject, relation, object"
WHOLE = "subject || ' ' || relation || ' ' || object"
QUESTION = "subject || ' ' || relation"
NOTHING = "CAST(NULL AS VARCHAR)"


def prompt_sql(input_: str, target: str, nonprompt: str, label: str) -> str:
    return (
        f"SELECT {FACT_COLUMNS}, {input_} AS input, {target} AS target, {nonprompt} AS nonprompt, {label} AS label "
        "FROM {fact_curr}"
    )


# --- prompts ---


@query(prompt_sql(WHOLE, WHOLE, "' ' || object", NOTHING))
def prompt_evaluate_ppl(t):
    return prompts.fact_prompts(t.fact_curr, "evaluate_ppl")


@query(prompt_sql(WHOLE, WHOLE, "' ' || object", NOTHING))
def prompt_default_validation(t):
    return prompts.fact_prompts(t.fact_curr, "pretrain")


@query(prompt_sql(QUESTION, "object", NOTHING, NOTHING))
def prompt_evaluate(t):
    return prompts.fact_prompts(t.fact_curr, "evaluate")


@query(prompt_sql(QUESTION, "object", NOTHING, WHOLE))
def prompt_finetune_validation(t):
    return prompts.fact_prompts(t.fact_curr, "finetune")


@query(prompt_sql(WHOLE, WHOLE, NOTHING, WHOLE))
def prompt_finetune_train(t):
    return prompts.fact_prompts(t.fact_curr, "finetune", role="train")


@query("SELECT doc_id, text AS input, text AS target FROM documents WHERE text IS NOT NULL")
def prompt_text(t):
    return prompts.text_prompts(t.documents).select("doc_id", "input", "target")


@query(
    """SELECT a.conv_id, a.turn, a.text AS input, b.text AS target FROM conversations a
       JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1"""
)
def prompt_pairs(t):
    a, b = t.conversations.alias("a"), t.conversations.alias("b")
    follows = (F.col("b.conv_id") == F.col("a.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1)
    chunks = a.join(b, follows).select("a.conv_id", "a.turn", F.col("a.text").alias("input"), F.col("b.text").alias("output"))
    return prompts.chunk_prompts(chunks, "T5").select("conv_id", "turn", "input", "target")


# --- text clean-up ---


@query(
    """SELECT doc_id, translate(replace(replace('<pad>' || text || '</s><pad>', '<pad>', ''), '</s>', ''), '.,''"', '')
       AS text FROM documents"""
)
def drop_marks(t):
    marked = F.concat(F.lit("<pad>"), F.col("text"), F.lit("</s><pad>"))
    return t.documents.select("doc_id", T.drop_marks(marked).alias("text"))


@query(
    """SELECT doc_id, CASE WHEN instr(text, '.') > 0 THEN substring(text, 1, instr(text, '.')) ELSE text END AS text
       FROM documents"""
)
def first_sentence(t):
    return t.documents.select("doc_id", T.first_sentence(F.col("text")).alias("text"))


NORMAL_WORDS = r"""list_filter(string_split_regex(
    regexp_replace(lower({}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda x: x NOT IN ('', 'a', 'an', 'the'))"""


def normal_words(column: str) -> str:
    # Doubled braces survive the stand-in names, which are words in single braces.
    return NORMAL_WORDS.format(column)


@query(f"SELECT doc_id, array_to_string({normal_words('text')}, ' ') AS text FROM documents")
def normalize_answer(t):
    return t.documents.select("doc_id", T.normalize_answer(F.col("text")).alias("text"))


SPACED = """replace(replace(replace(replace(text, '.', ' .'), ',', ' ,'), '(', '( '), 'nt ', ' n''t ')"""


@query(
    rf"""SELECT doc_id, regexp_replace(
           replace(replace(replace(replace(replace({SPACED}, ' n''t', 'n''t'), ' )', ')'), '( ', '('), '" ', '"'), ' "', '"'),
           ' ([''.,])', '\1', 'g') AS text FROM documents"""
)
def detokenize(t):
    spaced = t.documents.select("doc_id", F.expr(SPACED.replace("''", "\\'")).alias("text"))
    return spaced.select("doc_id", T.detokenize(F.col("text")).alias("text"))


ARGUMENTS = (
    "' type=' || event_type || ',user=' || CAST(user_id AS VARCHAR(20)) || "
    "CASE WHEN event_type = 'error' THEN ',type=again' WHEN event_type = 'signup' THEN ',plain' ELSE '' END"
)


@query(
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'again' ELSE event_type END AS type,
              CAST(user_id AS VARCHAR) AS "user" FROM events WHERE event_type <> 'signup'"""
)
def parse_arguments(t):
    given = t.events.select("event_id", F.expr(ARGUMENTS).alias("args")).filter(T.arguments_are_valid(F.col("args")))
    parsed = given.select("event_id", T.parse_arguments(F.col("args")).alias("a"))
    return parsed.select("event_id", F.col("a")["type"].alias("type"), F.col("a")["user"].alias("user"))


@query("SELECT event_id FROM events WHERE event_type = 'signup'")
def parse_arguments_rejects(t):
    given = t.events.select("event_id", F.expr(ARGUMENTS).alias("args"))
    return given.filter(~T.arguments_are_valid(F.col("args"))).select("event_id")


# --- arrays: word lengths stand for ids, 3 for padding, the whole text for one sequence ---

IDS = "list_transform(w, lambda x: CAST(length(x) AS INTEGER))"


def id_rows(t):
    return t.id_rows.select("doc_id", F.transform("w", F.length).alias("ids"))


def joined(column):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), " ")


@query(f"SELECT doc_id, array_to_string(list_slice({IDS}, 26, len(w)), ' ') AS ids FROM {{id_rows}}")
def strip_prompt(t):
    return id_rows(t).select("doc_id", joined(A.strip_prompt(F.col("ids"), 25)).alias("ids"))


@query(
    f"""SELECT doc_id, array_to_string(list_transform({IDS}, lambda x: CASE WHEN x = 3 THEN -100 ELSE x END), ' ') AS ids
        FROM {{id_rows}}"""
)
def mask_padding(t):
    return id_rows(t).select("doc_id", joined(A.mask_padding(F.col("ids"), 3)).alias("ids"))


@query(f"SELECT doc_id, array_to_string(list_slice({IDS}, 2, len(w)), ' ') AS ids FROM {{id_rows}}")
def next_labels(t):
    return id_rows(t).select("doc_id", joined(A.next_labels(F.col("ids"))).alias("ids"))


@query(
    f"""SELECT doc_id, array_to_string(list_concat([0], list_transform(list_slice({IDS}, 1, len(w) - 1),
               lambda x: CASE WHEN x = 4 THEN 3 ELSE x END)), ' ') AS ids FROM {{id_rows}}"""
)
def shift_right(t):
    labels = F.transform("ids", lambda x: F.when(x == 4, A.IGNORED_LABEL).otherwise(x))
    rows = id_rows(t).select("doc_id", labels.alias("ids"))
    return rows.select("doc_id", joined(A.shift_right(F.col("ids"), 0, 3)).alias("ids"))


WINDOW, CONTEXT = 100, 25
STEP = WINDOW - CONTEXT + 1
WINDOWS = f"""
    WITH n AS (SELECT doc_id, {IDS} AS ids, CAST(len(w) AS INTEGER) AS n FROM {{id_rows}}),
    k AS (SELECT doc_id, ids, n,
                 unnest(generate_series(0, CAST(ceil(greatest(n - {WINDOW}, 0) / {STEP}.0) AS INTEGER))) AS i
          FROM n),
    e AS (SELECT *, CASE WHEN i = 0 THEN 0 ELSE {WINDOW} + (i - 1) * {STEP} END AS done,
                 CASE WHEN i = 0 THEN least(n, {WINDOW}) ELSE least({WINDOW} + i * {STEP}, n) END AS e FROM k),
    windows AS (SELECT doc_id, CAST(i AS INTEGER) AS window_no,
                       CASE WHEN i = 0 THEN list_concat([0], list_slice(ids, 1, e - 1))
                            ELSE list_slice(ids, e - {WINDOW}, e - 1) END AS input,
                       list_slice(ids, done + 1, e) AS predicted FROM e)"""


def windows(t):
    found = id_rows(t).select("doc_id", F.posexplode(A.rolling_windows(F.col("ids"), 0, WINDOW, CONTEXT)).alias("window_no", "w"))
    return found.select("doc_id", "window_no", "w")


@query(
    f"""{WINDOWS} SELECT doc_id, window_no, array_to_string(input, ' ') AS input,
                         array_to_string(predicted, ' ') AS predicted FROM windows"""
)
def rolling_windows(t):
    return windows(t).select(
        "doc_id", "window_no", joined(F.col("w.input")).alias("input"), joined(F.col("w.predicted")).alias("predicted")
    )


@query(
    f"""{WINDOWS} SELECT doc_id, window_no, array_to_string(CASE WHEN len(predicted) = 1 THEN []
        ELSE list_slice(input, 1, len(input) - len(predicted) + 1) END, ' ') AS input FROM windows"""
)
def disjoint_windows(t):
    return windows(t).select("doc_id", "window_no", joined(A.disjoint_input(F.col("w"))).alias("input"))


@query(
    f"""SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, array_to_string(list_slice(ids, i * 100 + 1, i * 100 + 100), ' ') AS ids
        FROM (SELECT doc_id, {IDS} AS ids, unnest(generate_series(0, CAST((len(w) - 1) // 100 AS INTEGER))) AS i
              FROM {{id_rows}})"""
)
def array_chunks(t):
    found = id_rows(t).select("doc_id", F.posexplode(A.chunked(F.col("ids"), 100)).alias("chunk_no", "c"))
    return found.select("doc_id", "chunk_no", joined(F.col("c")).alias("ids"))


@query(f"SELECT doc_id, array_to_string(list_concat({IDS}, [-1], {IDS}), ' ') AS ids FROM {{id_rows}}")
def joined_arrays(t):
    return id_rows(t).select("doc_id", joined(A.joined(F.col("ids"), F.array(F.lit(-1)), F.col("ids"))).alias("ids"))


# --- names and modes ---


@query(
    """SELECT run_no, CASE WHEN contains(dataset, 'unchanged') THEN 'unchanged' ELSE 'changed' END AS split,
              CASE WHEN contains(model, 't5') THEN 'T5' ELSE 'GPT2' END AS family,
              dataset_version IN ('small', 'full') AS version_ok,
              mode IN ('pretrain', 'finetune', 'evaluate') AS generation_ok,
              mode IN ('pretrain', 'finetune', 'evaluate_ppl', 'evaluate_ppl_corpus') AS perplexity_ok
       FROM {runs}"""
)
def run_checks(t):
    return t.runs.select(
        "run_no", P.split_of_name(F.col("dataset")).alias("split"), P.model_family(F.col("model")).alias("family"),
        P.is_version(F.col("dataset_version")).alias("version_ok"), P.is_mode(F.col("mode"), "generation").alias("generation_ok"),
        P.is_mode(F.col("mode"), "perplexity").alias("perplexity_ok"),
    )


# --- answer scores ---

EM = f"CASE WHEN {normal_words('prediction')} = {normal_words('target')} THEN 1 ELSE 0 END"


@query(
    f"""
    WITH asked AS (SELECT *, subject || relation AS id FROM {{fact_curr}}),
    pairs AS (
        SELECT row_number() OVER () AS id, object AS target,
               CASE WHEN instr(prediction, '.') > 0 THEN substring(prediction, 1, instr(prediction, '.')) ELSE prediction END
               AS prediction
        FROM {{fact_curr}} JOIN {{fact_pred}} USING (subject, relation)),
    words AS (SELECT id, {normal_words('prediction')} AS p, {normal_words('target')} AS t FROM pairs),
    sides AS (
        SELECT id, w, sum(p) AS p, sum(t) AS t FROM (
            SELECT id, unnest(p) AS w, 1 AS p, 0 AS t FROM words UNION ALL SELECT id, unnest(t), 0, 1 FROM words)
        GROUP BY id, w),
    same AS (SELECT id, sum(least(p, t)) AS same, sum(p) AS np, sum(t) AS nt FROM sides GROUP BY id),
    scored AS (
        SELECT w.id, CASE WHEN w.p = w.t THEN 1 ELSE 0 END AS em,
               CASE WHEN same > 0 THEN 2 * (same / np) * (same / nt) / (same / np + same / nt) ELSE 0 END AS f1
        FROM words w JOIN same USING (id))
    SELECT count(*) AS total, CAST(sum(em) AS BIGINT) AS correct, round(avg(em), 6) AS em_rate, round(avg(f1), 6) AS f1
    FROM scored"""
)
def probe_scores(t):
    result = evaluate.answer_scores(t.fact_curr, t.fact_pred, ["subject", "relation"])
    return result.select("total", "correct", F.round("em_rate", 6).alias("em_rate"), F.round("f1", 6).alias("f1"))


LONG_SCORES = f"""
    WITH words AS (SELECT example_id, {normal_words('prediction')} AS p, {normal_words('target')} AS t FROM {{text_pairs}}),
    sides AS (
        SELECT example_id, w, sum(p) AS p, sum(t) AS t FROM (
            SELECT example_id, unnest(p) AS w, 1 AS p, 0 AS t FROM words
            UNION ALL SELECT example_id, unnest(t), 0, 1 FROM words)
        GROUP BY example_id, w),
    same AS (SELECT example_id, sum(least(p, t)) AS same, sum(p) AS np, sum(t) AS nt FROM sides GROUP BY example_id),
    scored AS (
        SELECT w.example_id, CASE WHEN w.p = w.t THEN 1 ELSE 0 END AS em,
               CASE WHEN coalesce(same, 0) > 0
                    THEN 2 * (same / np) * (same / nt) / (same / np + same / nt) ELSE 0 END AS f1
        FROM words w LEFT JOIN same USING (example_id))"""


@query(LONG_SCORES.replace("{text_pairs}", "{gap_pairs}") + " SELECT example_id, em, round(CAST(f1 AS DOUBLE), 6) AS f1 FROM scored")
def answer_scores_without_sides(t):
    found = scores.score_answers(t.gap_pairs, ["example_id"])
    return found.select("example_id", "em", F.round("f1", 6).alias("f1"))


@query(LONG_SCORES + " SELECT example_id, em, round(f1, 6) AS f1 FROM scored")
def answer_scores_long(t):
    found = scores.score_answers(t.text_pairs, ["example_id"])
    return found.select("example_id", "em", F.round("f1", 6).alias("f1"))


@query(
    LONG_SCORES + """ SELECT count(*) AS total, CAST(sum(em) AS BIGINT) AS correct, round(avg(em) * 100, 6) AS em_rate,
                             round(avg(f1) * 100, 6) AS f1 FROM scored"""
)
def answer_scores_percent(t):
    result = scores.summarize(scores.score_answers(t.text_pairs, ["example_id"]), scale=100)
    return result.select("total", "correct", F.round("em_rate", 6).alias("em_rate"), F.round("f1", 6).alias("f1"))


@query(
    """SELECT round(avg(CASE WHEN regexp_replace(p, '^\\s+|\\s+$', '', 'g') = regexp_replace(t, '^\\s+|\\s+$', '', 'g')
                        THEN 1 ELSE 0 END) * 100, 6) AS accuracy
       FROM (SELECT chr(10) || prediction || '  ' AS p, replace(target, 'The ', '') AS t FROM {text_pairs})"""
)
def answer_accuracy(t):
    pairs = t.text_pairs.select(
        F.concat(F.lit("\n"), F.col("prediction"), F.lit("  ")).alias("prediction"),
        F.expr("replace(target, 'The ', '')").alias("target"),
    )
    return pairs.agg(F.round(F.avg(scores.accuracy()) * 100, 6).alias("accuracy"))


@query(
    """SELECT count(*) AS total, round(avg(CASE WHEN p = t THEN 1 ELSE 0 END) * 100, 6) AS accuracy
       FROM (SELECT regexp_replace(prediction, '^\\s+|\\s+$', '', 'g') AS p,
                    regexp_replace(substr(target, 5), '^\\s+|\\s+$|\\s+,\\s*$', '', 'g') AS t FROM {gap_pairs})"""
)
def answer_accuracy_with_gaps(t):
    # The targets of every fourth pair lose what was put around them; a third of all answers and targets are missing.
    pairs = t.gap_pairs.withColumn("target", F.regexp_replace(F.expr("substr(target, 5)"), r"\s+,\s*$", ""))
    return pairs.agg(F.count("*").alias("total"), F.round(F.avg(scores.accuracy()) * 100, 6).alias("accuracy"))


ROW_RANGE_BATCH, ROW_RANGE_DEVICES = 4, 1


@query(
    f"""
    WITH pairs AS (
        SELECT (row_number() OVER (ORDER BY subject, relation) - 1) // {ROW_RANGE_BATCH} AS batch_id,
               CASE WHEN lower(object) = lower(replace(replace(prediction, 'The ', ''), '. It is there', '')) THEN 1 ELSE 0 END AS em
        FROM {{fact_curr}} JOIN {{fact_pred}} USING (subject, relation)),
    named AS (
        SELECT CASE WHEN batch_id < {10_000 // (ROW_RANGE_BATCH * ROW_RANGE_DEVICES)} THEN 'UnL'
                    WHEN batch_id < {10_785 // (ROW_RANGE_BATCH * ROW_RANGE_DEVICES)} THEN 'UL'
                    WHEN batch_id < {12_329 // (ROW_RANGE_BATCH * ROW_RANGE_DEVICES)} THEN 'NL' ELSE 'IL' END AS split,
               batch_id, em FROM pairs)
    SELECT split, count(*) AS batches, round(avg(em), 6) AS em
    FROM (SELECT split, batch_id, avg(em) AS em FROM named GROUP BY ALL) GROUP BY split"""
)
def row_range_scores(t):
    pairs = scores.match_predictions(t.fact_curr, t.fact_pred, ["subject", "relation"])
    pairs = pairs.withColumn("prediction", T.first_sentence(F.col("prediction"))).withColumnRenamed("object", "target")
    placed = with_position(scores.score_short_answers(pairs), ["subject", "relation"])
    batches = placed.withColumn("batch_id", batch_of(F.col("position"), ROW_RANGE_BATCH)).groupBy("batch_id").agg(F.avg("em").alias("em"))
    split = scores.row_range_split(F.col("batch_id"), ROW_RANGE_BATCH, ROW_RANGE_DEVICES).alias("split")
    return batches.groupBy(split).agg(F.count("*").alias("batches"), F.round(F.avg("em"), 6).alias("em"))
