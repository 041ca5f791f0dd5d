"""Queries on perplexity, positions, batches, samples and replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import ordinals, perplexity, sampling
from tidemark.plans.registry import query
from tidemark.sources import manifest

CLASSES = ["click", "error", "purchase", "signup", "view"]


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


# --- perplexity ---


@query("SELECT batch_id, round(avg(nll), 9) AS loss, count(nll) AS tokens FROM {token_loss} GROUP BY batch_id")
def batch_losses(t):
    # Means of 32 values with three decimals: nine decimals leave no ties to round.
    return perplexity.batch_losses(t.token_loss).withColumn("loss", F.round("loss", 9))


@query("SELECT round(exp(avg(loss)), 6) AS ppl FROM (SELECT batch_id, avg(nll) AS loss FROM {token_loss} GROUP BY batch_id)")
def perplexity_overall(t):
    return rounded(perplexity.perplexity(t.token_loss), "ppl")


@query("SELECT split, round(exp(avg(nll)), 6) AS ppl FROM {token_loss} GROUP BY split")
def perplexity_by_token(t):
    return rounded(perplexity.perplexity(t.token_loss, ["split"], weighting="token"), "ppl")


@query(
    """SELECT split, round(exp(avg(loss)), 6) AS ppl
       FROM (SELECT split, batch_id, avg(nll) AS loss FROM {token_loss} GROUP BY ALL) GROUP BY split"""
)
def perplexity_by_split(t):
    return rounded(perplexity.perplexity(t.token_loss, ["split"]), "ppl")


@query(
    """SELECT split, round(exp(avg(loss)), 6) AS ppl
       FROM (SELECT split, batch_id, avg(nll) AS loss FROM {token_loss} WHERE label <> -100 GROUP BY ALL) GROUP BY split"""
)
def perplexity_scored_only(t):
    return rounded(perplexity.perplexity(perplexity.scored_only(t.token_loss), ["split"]), "ppl")


BY_CLASS = ", ".join(f'avg(CASE WHEN word_class = \'{c}\' THEN nll END) AS "{c}"' for c in CLASSES)
PPL_BY_CLASS = ", ".join(f'round(exp(avg("{c}")), 6) AS "{c}"' for c in ["all", *CLASSES])


@query(
    f"""SELECT {PPL_BY_CLASS} FROM (SELECT batch_id, avg(nll) AS "all", {BY_CLASS} FROM {{token_loss}} GROUP BY batch_id)"""
)
def perplexity_by_class(t):
    return rounded(perplexity.class_perplexity(t.token_loss, CLASSES), "all", *CLASSES)


@query(
    f"""SELECT split, {PPL_BY_CLASS} FROM (
            SELECT split, batch_id, avg(nll) AS "all", {BY_CLASS} FROM {{token_loss}} GROUP BY ALL) GROUP BY split"""
)
def perplexity_by_class_and_split(t):
    return rounded(perplexity.class_perplexity(t.token_loss, CLASSES, ["split"]), "all", *CLASSES)


NAN_BY_CLASS = ", ".join(
    f"coalesce(avg(CASE WHEN word_class = '{c}' THEN nll END), CAST('nan' AS DOUBLE)) AS \"{c}\"" for c in CLASSES
)
IS_UNDEFINED = ", ".join(f'isnan(exp(avg("{c}"))) AS "{c}"' for c in CLASSES)


@query(
    f"""SELECT split, {IS_UNDEFINED} FROM (SELECT split, batch_id, {NAN_BY_CLASS} FROM {{token_loss}} GROUP BY ALL)
        GROUP BY split"""
)
def undefined_classes(t):
    found = perplexity.class_perplexity(t.token_loss, CLASSES, ["split"], empty="propagate")
    return found.select("split", *[F.isnan(c).alias(c) for c in CLASSES])


@query(
    """SELECT batch_id, round(exp(avg(loss) OVER (ORDER BY batch_id)), 6) AS running_ppl
       FROM (SELECT batch_id, avg(nll) AS loss FROM {token_loss} GROUP BY batch_id)"""
)
def running_perplexity(t):
    found = perplexity.running_perplexity(perplexity.batch_losses(t.token_loss), [], width=64)
    return rounded(found.select("batch_id", "running_ppl"), "running_ppl")


@query(
    """SELECT split, batch_id, round(exp(avg(loss) OVER (PARTITION BY split ORDER BY batch_id)), 6) AS running_ppl
       FROM (SELECT split, batch_id, avg(nll) AS loss FROM {gap_loss} GROUP BY ALL)"""
)
def running_perplexity_without_split(t):
    losses = t.gap_loss.groupBy("split", "batch_id").agg(F.avg("nll").alias("loss"))
    found = perplexity.running_perplexity(losses, ["split"], width=64)
    return rounded(found.select("split", "batch_id", "running_ppl"), "running_ppl")


@query(
    """SELECT split, batch_id, round(exp(avg(loss) OVER (PARTITION BY split ORDER BY batch_id)), 6) AS running_ppl
       FROM (SELECT split, batch_id, avg(nll) AS loss FROM {token_loss} GROUP BY ALL)"""
)
def running_perplexity_by_split(t):
    found = perplexity.running_perplexity(perplexity.batch_losses(t.token_loss, ["split"]), ["split"], width=64)
    return rounded(found.select("split", "batch_id", "running_ppl"), "running_ppl")


PASS = 100  # batches in a validation pass


@query(
    f"""SELECT split, batch_id // {PASS} AS pass, batch_id,
               round(exp(avg(loss) OVER (PARTITION BY split, batch_id // {PASS} ORDER BY batch_id)), 6) AS running_ppl
        FROM (SELECT split, batch_id, avg(nll) AS loss FROM {{token_loss}} GROUP BY ALL)"""
)
def running_perplexity_per_pass(t):
    batches = perplexity.batch_losses(t.token_loss, ["split"]).withColumn("pass", F.floor(F.col("batch_id") / PASS))
    found = perplexity.running_perplexity(batches, ["split", "pass"], width=64)
    return rounded(found.select("split", "pass", "batch_id", "running_ppl"), "running_ppl")


# --- positions and batches ---


@query(
    """SELECT file_row_number AS position, file_row_number // 32 AS batch_id, doc_id
       FROM (SELECT doc_id, doc_id AS file_row_number FROM documents)"""
)
def batch_ids_in_file_order(t):
    placed = t.positioned("documents")
    return placed.select("position", ordinals.batch_of(F.col("position"), 32).alias("batch_id"), "doc_id")


@query("SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 32 AS batch_id FROM documents")
def batch_ids(t):
    placed = ordinals.with_position(t.documents.select("doc_id", "lang"), ["doc_id"], ["lang"])
    return placed.select("doc_id", "lang", ordinals.batch_of(F.col("position"), 32).alias("batch_id"))


@query("SELECT event_id, event_id // 7 // 3 AS global_epoch, event_id // 7 % 3 AS file_no FROM events")
def epoch_cursor(t):
    epoch, file = sampling.epoch_cursor(F.floor(F.col("event_id") / 7), 3)
    return t.events.select("event_id", epoch.alias("global_epoch"), file.alias("file_no"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def row_counts(t):
    return t.documents.groupBy("lang", "source").agg(F.count("*").alias("n"))


@query(
    """SELECT run_no, len_data // train_batch_size AS batches,
              len_data // train_batch_size // nullif(ngpu * coalesce(gradient_accumulation_steps, 0), 0) + 1 AS epoch_steps,
              (len_data // train_batch_size // nullif(ngpu * coalesce(gradient_accumulation_steps, 0), 0) + 1)
                  * coalesce(num_train_epochs, 0) * coalesce(num_files, 1)
                  * CASE WHEN contains(model, 't5') THEN 6 ELSE 8 END AS total_steps
       FROM {runs}"""
)
def training_steps(t):
    optional = ["output_log", "learning_rate", "use_lr_scheduling", "num_workers", "output_dir", "wandb_log", "accelerator",
                "checkpoint_path", "resume_from_checkpoint", "fp16", "grad_norm", "weight_decay"]
    types = {"learning_rate": "double", "use_lr_scheduling": "boolean", "num_workers": "int", "wandb_log": "boolean",
             "fp16": "boolean", "grad_norm": "double", "weight_decay": "double"}
    runs = t.runs.withColumns({c: F.lit(None).cast(types.get(c, "string")) for c in optional})
    return manifest.training_steps(manifest.with_defaults(runs)).select("run_no", "batches", "epoch_steps", "total_steps")


# --- samples, shuffles and replay ---


@query(
    """SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS r
       FROM documents) WHERE r <= 137"""
)
def sample_exact(t):
    return sampling.sample_exact(t.documents.select("doc_id", "text"), ["doc_id"], 137)


@query(
    """SELECT doc_id, row_number() OVER (ORDER BY md5('42:1:' || doc_id), doc_id) - 1 AS position FROM documents"""
)
def shuffled(t):
    return sampling.shuffled(t.documents.select("doc_id"), ["doc_id"], 42, 1)


@query(
    """SELECT doc_id, position, position // 32 AS batch_id
       FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:0:' || doc_id), doc_id) - 1 AS position FROM documents)
       WHERE position // 32 < (SELECT count(*) // 32 FROM documents)"""
)
def training_batches(t):
    return sampling.training_batches(t.documents.select("doc_id"), ["doc_id"], 32).select("doc_id", "position", "batch_id")


@query(
    """SELECT epoch, CAST(floor(n * 1.0 * pow(0.7, epoch)) AS BIGINT) AS size
       FROM (SELECT count(*) AS n FROM documents), (VALUES (0), (1), (2), (3)) e(epoch)"""
)
def replay_sizes(t):
    epochs = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("epoch")
    sizes = [sampling.replay_size(F.col("n"), 1.0, 0.7, e) for e in range(4)]
    return t.documents.agg(F.count("*").alias("n")).select("n", epochs).select(
        "epoch", F.element_at(F.array(*sizes), F.col("epoch") + 1).alias("size")
    )


CHANGED = """
    WITH diff AS (SELECT c.page_id, c.text FROM {snap_curr} c LEFT JOIN {snap_prev} p ON p.page_id = c.page_id
                  WHERE p.page_id IS NULL OR p.text <> c.text)"""


def changed_pages(t):
    from tidemark.operators import snapshots

    return snapshots.changed_pages(t.snap_prev, t.snap_curr)


@query(
    CHANGED + """
    SELECT page_id, md5(text) AS text, 'new' AS origin FROM diff
    UNION ALL
    SELECT page_id, md5(text), 'old' FROM (
        SELECT *, row_number() OVER (ORDER BY md5('42:' || page_id), page_id) AS r FROM {snap_prev})
    WHERE r <= (SELECT count(*) FROM diff)"""
)
def replay_mix(t):
    mixed = sampling.replay_mix(changed_pages(t), t.snap_prev, ["page_id"])
    return mixed.select("page_id", F.md5("text").alias("text"), "origin")


@query(
    CHANGED + """,
    old AS (SELECT page_id, 'old' AS origin FROM (
                SELECT *, row_number() OVER (ORDER BY md5('43:' || page_id), page_id) AS r FROM {snap_prev})
            WHERE r <= (SELECT floor(count(*) * pow(0.7, 1)) FROM diff)),
    mixed AS (SELECT page_id, 'new' AS origin FROM diff UNION ALL SELECT * FROM old),
    placed AS (SELECT *, row_number() OVER (ORDER BY md5('42:1:' || origin || ':' || page_id), origin, page_id) - 1 AS position
               FROM mixed)
    SELECT page_id, origin, position, position // 8 AS batch_id FROM placed
    WHERE position // 8 < (SELECT count(*) // 8 FROM mixed)"""
)
def replay_batches(t):
    mixed = sampling.replay_mix(
        changed_pages(t).select("page_id"), t.snap_prev.select("page_id"), ["page_id"], epoch=1, decay=0.7
    )
    return sampling.training_batches(mixed, ["origin", "page_id"], 8, epoch=1).select("page_id", "origin", "position", "batch_id")


@query(
    """SELECT subject, relation, object,
              CASE WHEN r <= 500 THEN 'tuning' ELSE 'evaluation' END AS part
       FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || subject || ':' || relation)) AS r FROM {fact_curr})"""
)
def hold_out(t):
    tuning, rest = sampling.hold_out(t.fact_curr, ["subject", "relation"])
    return sampling.tagged_union({"tuning": tuning, "evaluation": rest}, "part").select("subject", "relation", "object", "part")


@query(
    """SELECT 'prev' AS split, 0 AS split_no, count(*) AS n FROM {fact_prev}
       UNION ALL SELECT 'curr', 1, count(*) FROM {fact_curr}"""
)
def tagged_sets(t):
    both = sampling.tagged_union({"prev": t.fact_prev, "curr": t.fact_curr})
    return both.groupBy("split", "split_no").agg(F.count("*").alias("n"))
