"""Queries on snapshot differences, grouping and month pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import grouping, snapshots
from tidemark.operators.ordinals import with_position
from tidemark.plans.registry import query

PAGE_STATUS = """
    status AS (
        SELECT coalesce(c.page_id, p.page_id) AS page_id,
               CASE WHEN p.page_id IS NULL THEN 'new' WHEN c.page_id IS NULL THEN 'deleted'
                    WHEN p.text = c.text THEN 'unchanged' ELSE 'updated' END AS status
        FROM {snap_prev} p FULL JOIN {snap_curr} c ON c.page_id = p.page_id)"""


@query(f"WITH {PAGE_STATUS} SELECT page_id, status FROM status")
def page_diff(t):
    return snapshots.page_diff(t.snap_prev, t.snap_curr)


GAP_STATUS = """
    status AS (
        SELECT coalesce(c.page_id, p.page_id) AS page_id,
               CASE WHEN p.page_id IS NULL THEN 'new' WHEN c.page_id IS NULL THEN 'deleted'
                    WHEN p.text IS NOT DISTINCT FROM c.text THEN 'unchanged' ELSE 'updated' END AS status
        FROM {gap_prev} p FULL JOIN {gap_curr} c ON c.page_id = p.page_id)"""


@query(f"WITH {GAP_STATUS} SELECT page_id, status FROM status")
def page_diff_without_texts(t):
    return snapshots.page_diff(t.gap_prev, t.gap_curr)


@query(f"WITH {GAP_STATUS} SELECT page_id, c.text FROM {{gap_curr}} c JOIN status USING (page_id) WHERE status IN ('new', 'updated')")
def changed_pages_without_texts(t):
    return snapshots.changed_pages(t.gap_prev, t.gap_curr)


SENTENCES = r"""list_filter(list_transform(regexp_extract_all({}, '[^.!?\n]+[.!?]*'), lambda x: trim(x)), lambda x: x <> '')"""
NOVEL = f"""
    WITH {PAGE_STATUS},
    s AS (SELECT page_id, {SENTENCES.format('text')} AS s FROM {{snap_curr}} JOIN status USING (page_id)
          WHERE status IN ('new', 'updated')),
    now AS (SELECT page_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos FROM s),
    before AS (SELECT DISTINCT page_id, unnest({SENTENCES.format('text')}) AS sentence FROM {{snap_prev}}),
    novel AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, sentence FROM now
              WHERE NOT EXISTS (SELECT 1 FROM before b WHERE b.page_id = now.page_id AND b.sentence = now.sentence))"""


@query(f"{NOVEL} SELECT page_id, pos, sentence FROM novel")
def novel_sentences(t):
    return snapshots.novel_sentences(t.snap_prev, t.snap_curr)


@query(f"{NOVEL} SELECT page_id, string_agg(sentence, ' ' ORDER BY pos) AS text FROM novel GROUP BY page_id")
def diff_corpus(t):
    return snapshots.diff_corpus(t.snap_prev, t.snap_curr)


FACT_STATUS = """
    facts AS (
        SELECT DISTINCT c.subject, c.relation, c.object,
               CASE WHEN p.object IS NOT NULL THEN 'unchanged' WHEN r.subject IS NOT NULL THEN 'updated' ELSE 'new' END AS status,
               CASE WHEN p.object IS NOT NULL THEN 'unchanged' ELSE 'changed' END AS split
        FROM {fact_curr} c
        LEFT JOIN (SELECT DISTINCT * FROM {fact_prev}) p
            ON p.subject = c.subject AND p.relation = c.relation AND p.object = c.object
        LEFT JOIN (SELECT DISTINCT subject, relation FROM {fact_prev}) r
            ON r.subject = c.subject AND r.relation = c.relation)"""


@query(f"WITH {FACT_STATUS} SELECT subject, relation, object, status, split FROM facts")
def fact_diff(t):
    return snapshots.fact_diff(t.fact_prev, t.fact_curr)


@query(
    f"""WITH {FACT_STATUS},
    kinds AS (SELECT c.title, c.text, CASE WHEN p.text = c.text THEN 'unchanged' ELSE 'changed' END AS split
              FROM {{title_curr}} c LEFT JOIN {{title_prev}} p ON p.title = c.title)
    SELECT f.subject, f.relation, f.object, f.status, f.split FROM facts f
    JOIN kinds k ON k.title = f.subject AND k.split = f.split WHERE contains(k.text, f.object)"""
)
def aligned_facts(t):
    diff = snapshots.page_diff(t.title_prev, t.title_curr, "title")
    return snapshots.align_facts(snapshots.fact_diff(t.fact_prev, t.fact_curr), t.title_curr, diff)


PLAUSIBLE = """
    plausible AS (
        SELECT * FROM {fact_curr} WHERE NOT contains(lower(subject), lower(object)) AND NOT contains(lower(object), lower(subject))
        AND len(string_split_regex(trim(object), ' +')) <= 5)"""
FACT_HASH = "md5('42:' || subject || ':' || relation || ':' || object)"


@query(f"WITH {PLAUSIBLE} SELECT * FROM plausible")
def plausible_facts(t):
    return snapshots.filter_facts(t.fact_curr)


@query(
    f"""WITH {PLAUSIBLE},
    a AS (SELECT * FROM plausible QUALIFY row_number() OVER (PARTITION BY subject ORDER BY {FACT_HASH}) <= 1),
    b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY relation ORDER BY {FACT_HASH}) <= 200),
    c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY object ORDER BY {FACT_HASH}) <= 10)
    SELECT subject, relation, object FROM c"""
)
def capped_facts(t):
    return snapshots.filter_facts(t.fact_curr, caps={"subject": 1, "relation": 200, "object": 10})


@query(
    f"""SELECT subject, relation, object FROM {{fact_curr}}
        QUALIFY row_number() OVER (PARTITION BY relation ORDER BY {FACT_HASH}) <= 1200"""
)
def capped_hot_relation(t):
    return snapshots.cap_per_key(t.fact_curr, "relation", 1200)


@query(f"WITH {PLAUSIBLE.replace('{fact_curr}', '{odd_facts}')} SELECT * FROM plausible")
def plausible_odd_facts(t):
    return snapshots.plausible_facts(t.odd_facts)


SHARES = {"subject": 1, "relation": 300, "object": 50}
SHARE_ROUNDS = 12  # of the SQL, more than the tables need; a round too many changes nothing


def shares_sql() -> str:
    steps = ["s0 AS (SELECT subject, relation, object FROM {odd_facts})"]
    for i, (column, share) in enumerate(list(SHARES.items()) * SHARE_ROUNDS, 1):
        steps.append(f"""
        c{i} AS (SELECT c, count(*) AS keys FROM (SELECT count(*) AS c FROM s{i - 1} GROUP BY {column}) GROUP BY c),
        n{i} AS MATERIALIZED (SELECT max(n) AS n FROM (
            SELECT n, sum(keys * least(c, greatest(1, n * {share} // 1000))) AS stay
            FROM c{i}, (SELECT unnest(generate_series(1, (SELECT count(*) FROM s{i - 1}))) AS n) GROUP BY n) WHERE stay >= n),
        s{i} AS MATERIALIZED (SELECT subject, relation, object FROM (
            SELECT *, row_number() OVER (PARTITION BY {column} ORDER BY {FACT_HASH}, subject, relation, object) AS place FROM s{i - 1})
            WHERE place <= (SELECT greatest(1, n * {share} // 1000) FROM n{i}))""")
    return f"WITH {','.join(steps)} SELECT subject, relation, object FROM s{len(SHARES) * SHARE_ROUNDS}"


@query(shares_sql())
def shared_facts(t):
    return snapshots.share_caps(t.odd_facts, SHARES)


GAP_HASH = "md5(concat_ws(':', '42', subject, relation, object))"
GAP_CAP = """SELECT subject, relation, object FROM {{gap_facts}}
             QUALIFY row_number() OVER (PARTITION BY subject ORDER BY {}, object) <= {}"""


@query(GAP_CAP.format(GAP_HASH, 20))
def capped_without_subject(t):
    return snapshots.cap_per_key(t.gap_facts, "subject", 20)


@query(GAP_CAP.format(GAP_HASH, 1200))
def capped_without_subject_by_buckets(t):
    return snapshots.cap_per_key(t.gap_facts, "subject", 1200)


MONTHS = "strftime(o_orderdate, '%Y%m')"


@query(
    f"""SELECT prev_month, month, 'corpus_' || prev_month[5:6] || month[5:6] AS diff_name,
               prev_month[5:6] || '01-' || month[5:6] || '01' AS probe_name
        FROM (SELECT m AS prev_month, lead(m) OVER (ORDER BY m) AS month FROM (SELECT DISTINCT {MONTHS} AS m FROM orders))
        WHERE month IS NOT NULL"""
)
def month_pairs(t):
    return snapshots.month_pairs(t.orders.select(F.date_format("o_orderdate", "yyyyMM").alias("month")))


@query(
    """SELECT run_no, CASE WHEN model = 'gpt2-xl' THEN '0801-0901_' ELSE 'x_0801_0901_' END || dataset AS dataset FROM {runs}"""
)
def probe_names(t):
    name = F.when(F.col("model") == "gpt2-xl", "0801_0901_").otherwise("x_0801_0901_")
    return t.runs.select("run_no", snapshots.normalize_probe_name(F.concat(name, "dataset")).alias("dataset"))


# --- grouping ---


@query(
    """WITH g AS (SELECT md5(text) AS group_key, min(doc_id) AS first FROM documents GROUP BY 1),
       n AS (SELECT group_key, row_number() OVER (ORDER BY first) - 1 AS group_pos FROM g)
       SELECT doc_id, group_pos, row_number() OVER (PARTITION BY group_pos ORDER BY doc_id) - 1 AS member_pos
       FROM documents JOIN n ON n.group_key = md5(text)"""
)
def grouped_by_text(t):
    return grouping.grouped(t.documents.select("doc_id", "text"), "doc_id", F.md5("text")).select("doc_id", "group_pos", "member_pos")


@query(
    """SELECT doc_id, dense_rank() OVER (ORDER BY lang) - 1 AS group_pos,
              row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS member_pos FROM documents"""
)
def grouped_by_lang_sorted(t):
    found = grouping.grouped(t.documents.select("doc_id", "lang"), "doc_id", F.col("lang"), order="key")
    return found.select("doc_id", "group_pos", "member_pos")


@query("SELECT doc_id, length(text) + 1 AS cost FROM documents")
def once_per_text(t):
    # The work is done per different text; here it is a count of its characters.
    texts = t.documents.select("doc_id", "text")
    work = lambda keys: keys.withColumn("cost", (F.length("group_key") + 1).cast("long"))
    return grouping.once_per_key(texts, F.col("text"), work).select("doc_id", "cost")


@query(
    """SELECT CAST(count(*) FILTER (md5(text) NOT IN (SELECT md5(text) FROM documents WHERE lang <> 'fr')) AS INTEGER) AS uncovered,
              count(*) AS rows FROM documents"""
)
def restore_coverage(t):
    # Results for all texts but the French ones.
    texts = t.documents.select("doc_id", F.md5("text").alias("h"))
    results = t.documents.filter("lang <> 'fr'").groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("first"))
    missing = grouping.uncovered(texts, results, ["h"]).agg(F.count("*")).scalar()
    return texts.agg(F.count("*").alias("rows")).select(missing.cast("int").alias("uncovered"), "rows")


@query(
    """SELECT lang, chunk_id, string_agg(CAST(doc_id AS VARCHAR), ' ' ORDER BY doc_id) AS items FROM (
           SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 16 AS chunk_id FROM documents)
       GROUP BY ALL"""
)
def table_chunks(t):
    placed = with_position(t.documents.select("doc_id", "lang"), ["doc_id"], ["lang"])
    found = grouping.chunks(placed, "position", 16, "doc_id", ["lang"])
    return found.select("lang", "chunk_id", F.array_join(F.transform("items", lambda x: x.cast("string")), " ").alias("items"))
