"""Snapshots, facts, predictions and losses derived from the test tables.

Each is one SQL text that Spark and DuckDB both run, so both sides of a check start from the same
rows. Names in braces are tables or other stand-ins.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.ordinals import with_file_position
from tidemark.sources.tables import spread

VIEWS = {
    # Pages labelled low quality are new in the later snapshot, toxic ones are gone from it, and those
    # labelled good got a passage added; all others are unchanged.
    "snap_prev": """
        SELECT d.doc_id AS page_id, d.text FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id
        WHERE coalesce(l.quality, 1) = 1""",
    "added_passage": """
        SELECT doc_id, doc_id % (SELECT count(*) FROM {benchmark}) AS item_id FROM {documents}""",
    "snap_curr": """
        SELECT d.doc_id AS page_id,
               CASE WHEN l.quality = 1 THEN d.text || chr(10) || b.text ELSE d.text END AS text
        FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id
        JOIN {added_passage} p ON p.doc_id = d.doc_id JOIN {benchmark} b ON b.item_id = p.item_id
        WHERE NOT (coalesce(l.toxic, 0) = 1 AND coalesce(l.quality, 1) = 1)""",
    # Customers in debt are first known in the later snapshot; builders and suppliers in debt moved.
    "fact_prev": """
        SELECT c.c_name AS subject, 'is located in' AS relation, n.n_name AS object
        FROM {customer} c JOIN {nation} n ON n.n_nationkey = c.c_nationkey WHERE c.c_acctbal >= 0
        UNION ALL SELECT c_name, 'buys for', c_mktsegment FROM {customer}
        UNION ALL SELECT s.s_name, 'supplies from', n.n_name
        FROM {supplier} s JOIN {nation} n ON n.n_nationkey = s.s_nationkey""",
    "fact_curr": """
        SELECT c.c_name AS subject, 'is located in' AS relation, n.n_name AS object
        FROM {customer} c JOIN {nation} n ON n.n_nationkey =
             CASE WHEN c.c_mktsegment = 'BUILDING' THEN (c.c_nationkey + 1) % 25 ELSE c.c_nationkey END
        UNION ALL SELECT c_name, 'buys for', c_mktsegment FROM {customer}
        UNION ALL SELECT s.s_name, 'supplies from', n.n_name
        FROM {supplier} s JOIN {nation} n ON n.n_nationkey =
             CASE WHEN s.s_acctbal < 0 THEN (s.s_nationkey + 1) % 25 ELSE s.s_nationkey END""",
    # The earlier facts serve as answers about the later ones.
    "fact_pred": """
        SELECT subject, relation, 'The ' || object || '. It is there' AS prediction FROM {fact_prev}""",
    # Long texts against the next document; every fourth matches after normalising.
    "text_pairs": """
        SELECT a.doc_id AS example_id, a.text AS prediction,
               CASE WHEN a.doc_id % 4 = 0 THEN 'The ' || a.text || ' ,' ELSE coalesce(b.text, '') END AS target
        FROM {documents} a LEFT JOIN {documents} b ON b.doc_id = a.doc_id + 1""",
    # Events as losses: types stand for word classes, users for splits.
    "token_loss": """
        SELECT event_id AS pos, event_type AS word_class,
               CASE WHEN user_id % 3 = 0 THEN 'unchanged' WHEN user_id % 3 = 1 THEN 'changed' ELSE 'invariant' END AS split,
               CAST(floor(event_id / 32) AS BIGINT) AS batch_id, value / 10 AS nll,
               CASE WHEN event_type = 'error' THEN -100 ELSE CAST(user_id AS INTEGER) END AS label
        FROM {events}""",
    # The same with gaps: pages without text, facts without subject, answers and losses without a side or split.
    "gap_prev": """
        SELECT p.page_id, CASE WHEN length(p.text) % 3 = 0 THEN NULL ELSE p.text END AS text FROM {snap_prev} p""",
    "gap_curr": """
        SELECT c.page_id, CASE WHEN length(c.text) % 3 = 0 OR length(c.text) % 5 = 1 THEN NULL ELSE c.text END AS text FROM {snap_curr} c""",
    "gap_facts": """
        SELECT CASE WHEN object < 'F' THEN NULL ELSE subject END AS subject, relation, object FROM {fact_curr}""",
    "gap_pairs": """
        SELECT example_id, CASE WHEN example_id % 3 = 0 THEN NULL ELSE prediction END AS prediction,
               CASE WHEN example_id % 6 < 2 THEN NULL ELSE target END AS target
        FROM {text_pairs}""",
    "gap_loss": """
        SELECT CASE WHEN split = 'changed' THEN NULL ELSE split END AS split, batch_id, nll FROM {token_loss}""",
    # Facts that a filter must refuse: long objects, objects inside subjects and the other way round.
    "odd_facts": """
        SELECT subject, relation, object FROM {fact_curr}
        UNION ALL SELECT c_name, 'is called', c_name FROM {customer} WHERE c_acctbal < 1000
        UNION ALL SELECT c_name, 'is also', 'the ' || c_name FROM {customer} WHERE c_acctbal < 500
        UNION ALL SELECT 'the ' || s_name, 'is known as', s_name FROM {supplier}
        UNION ALL SELECT n_name, 'says', 'one  two three four ' || n_name || ' six' FROM {nation}
        UNION ALL SELECT n_name, 'tells', 'one  two three four five' FROM {nation}""",
    # Word lengths as token ids.
    "id_rows": """
        SELECT doc_id, split(text, ' ') AS w FROM {documents}""",
    # Pages about customers: their title is the subject, their text tells the facts of the time.
    "title_prev": """
        SELECT subject AS title, 'It ' || relation || ' ' || object || '.' AS text
        FROM {fact_prev} WHERE relation <> 'buys for'""",
    "title_curr": """
        SELECT subject AS title, 'It ' || relation || ' ' || object || '.' AS text
        FROM {fact_curr} WHERE relation <> 'buys for'""",
    # One run per order, some optional keys left out.
    "runs": """
        SELECT o_orderkey AS run_no,
               CASE o_orderstatus WHEN 'O' THEN 'gpt2-large' WHEN 'F' THEN 't5-base' ELSE 'gpt2-xl' END AS model,
               CASE WHEN o_orderpriority LIKE '1%' THEN 'tiny' WHEN o_orderpriority LIKE '2%' THEN 'small' ELSE 'full' END
                   AS dataset_version,
               CASE WHEN o_totalprice < 100000 THEN 'evaluate_ppl' WHEN o_totalprice < 200000 THEN 'finetune'
                    WHEN o_totalprice < 300000 THEN 'evaluate' ELSE 'pretrain_brute' END AS mode,
               CASE WHEN o_orderstatus = 'P' THEN 'new_unchanged_' ELSE 'new_changed_' END
                   || CAST(o_custkey AS VARCHAR(20)) AS dataset,
               CAST(1 + o_custkey % 32 AS INTEGER) AS train_batch_size,
               CAST(1 + o_custkey % 8 AS INTEGER) AS ngpu,
               CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(1 + o_custkey % 4 AS INTEGER) END
                   AS gradient_accumulation_steps,
               CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(1 + o_orderkey % 3 AS INTEGER) END AS num_train_epochs,
               CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(1 + o_orderkey % 2 AS INTEGER) END AS num_files,
               CAST(floor(o_totalprice) AS BIGINT) AS len_data
        FROM {orders}""",
}

CORPORA = {"documents": "doc_id"}  # tables of long texts and their keys
_NAME = re.compile(r"\{([a-z_]{3,})\}")  # not the classes of a pattern, such as {Lu}


class Tables:
    """The test tables of a folder as DataFrames, by attribute, and the stand-ins on them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def positioned(self, name: str) -> DataFrame:
        """A table with the position of each row in its file."""
        return spread(with_file_position(self.spark.read.parquet(self.path(name))), CORPORA.get(name))

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            sql = VIEWS[name]
            return self.spark.sql(sql, **{n: getattr(self, n) for n in set(_NAME.findall(sql))})
        path = self.path(name)
        if name in CORPORA:
            return spread(self.spark.read.parquet(path), CORPORA[name])
        return self.spark.read.parquet(path)


def oracle(body: str) -> str:
    """SQL for DuckDB: the stand-ins that ``body`` names in braces become common table expressions."""
    needed: list[str] = []

    def add(sql: str) -> None:
        for name in _NAME.findall(sql):
            if name in VIEWS and name not in needed:
                add(VIEWS[name])
                needed.append(name)

    add(body)
    plain = lambda sql: _NAME.sub(r"\1", sql).strip()
    # Both engines read "split(text, ' ')" and "floor(a / b)" the same way.
    ctes = ",\n".join(f"{name} AS (\n{plain(VIEWS[name])}\n)" for name in needed)
    body = plain(body)
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
