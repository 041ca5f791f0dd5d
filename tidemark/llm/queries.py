"""The queries of the operators, with production parameters, and their SQL."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    alignment, bpe, decontamination, html, licenses, ngram_join, packing, quality, topk, toxicity, urls, vector_codes, warc,
)
from tidemark.session import new_path

URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict of every page's URL."""
    return urls.judge_urls(_table(spark, folder, "pages"), urls.rule_table(spark, URL_RULES))


def op2_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    found = html.extract_pages(_table(spark, folder, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op3_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's number of shingles and its component of near duplicates."""
    return ngram_join.jaccard_components(_table(spark, folder, "documents"))


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality.judge_quality(_table(spark, folder, "documents"))


def op7_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    """Licences that every document states: their names joined by commas, and where they stand."""
    found = licenses.scan_licenses(_table(spark, folder, "documents"), licenses.sentence_table(spark))
    places = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["first"], m["last"], m["license"])), ",")
    return found.select("doc_id", F.array_join("licenses", ",").alias("licenses"), "n_matches", places.alias("matches"))


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to an archive and read back."""
    path = new_path(spark, "warc")
    warc.write_archive(_table(spark, folder, "pages"), path)
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The five highest inner products of every fiftieth vector."""
    return topk.top_k(_table(spark, folder, "embeddings"), every=50, k=5)


def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded to ids and decoded again."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode_documents(_table(spark, folder, "documents"), path, public_tokenizers.PATTERN)
    return bpe.decode_documents(encoded, path, public_tokenizers.PATTERN).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document by a model of the labels."""
    found = toxicity.detect_toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", "sentence", "sentence_score")


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document packed into sequences of 2048 tokens."""
    return packing.pack_documents(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers in every document."""
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    # Of the lists of groups only the digest is kept for the second pass.
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    found = alignment.align_corpus(_table(spark, folder, "documents"), *paths, groups=digest)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector as eight codebook indexes, with its error and that of its label."""
    found, codebooks = vector_codes.compress_vectors(_table(spark, folder, "embeddings"))
    said = ",".join(map(str, codebooks.reshape(-1).tolist()))
    return found.select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error",
        F.lit(hashlib.sha256(said.encode()).hexdigest()).alias("codebooks_sha256"))


def op13_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that lie in windows of benchmark items, and these items."""
    found = decontamination.find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_html_extraction": op2_html_extraction,
    "op3_ngram_join": op3_ngram_join,
    "op4_quality_rules": op4_quality_rules,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_license_scans": op7_license_scans,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_warc": op10_warc,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_vector_codes": op12_vector_codes,
    "op13_decontamination": op13_decontamination,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _codes_sql() -> str:
    """The rounds of k-means one after the other; every round is a table of its own."""
    rounds = []
    for r in range(1, vector_codes.ROUNDS + 2):
        apart = "list_sum(list_transform(list_zip(x.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        rounds.append(f"""
        a{r} AS MATERIALIZED (
            SELECT x.n, x.p, CAST(min({apart} * 16 + c.k) AS BIGINT) AS best FROM parts x JOIN c{r - 1} c ON c.p = x.p GROUP BY x.n, x.p)""")
        if r <= vector_codes.ROUNDS:
            rounds.append(f"""
        m{r} AS (
            SELECT p, k, list(mean ORDER BY i) AS x FROM (
                SELECT a.p, a.best % 16 AS k, t.i, CAST(floor(sum(x.x[t.i]) / count(*)) AS BIGINT) AS mean
                FROM a{r} a JOIN parts x ON x.n = a.n AND x.p = a.p, generate_series(1, len(x.x)) t(i) GROUP BY ALL) GROUP BY p, k),
        c{r} AS MATERIALIZED (
            SELECT c.p, c.k, coalesce(m.x, c.x) AS x FROM c{r - 1} c LEFT JOIN m{r} m ON m.p = c.p AND m.k = c.k)""")
    last = vector_codes.ROUNDS + 1
    return f"""
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, label,
                   list_transform(embedding, lambda x: CAST(floor({vector_codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS MATERIALIZED (SELECT n, t.p, e[t.p * len(e) // 8 + 1:(t.p + 1) * len(e) // 8] AS x FROM v, generate_series(0, 7) t(p)),
        c0 AS MATERIALIZED (SELECT p, n - 1 AS k, x FROM parts WHERE n <= 16),{",".join(rounds)},
        coded AS (
            SELECT n, string_agg(printf('%02x', best % 16), '' ORDER BY p) AS code, CAST(sum(best // 16) AS BIGINT) AS error FROM a{last} GROUP BY n),
        books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, k)) AS digest FROM c{last - 1}),
        labels_of AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM coded JOIN v USING (n) GROUP BY label)
        SELECT v.vec_id, coded.code, coded.error, l.label_error, books.digest AS codebooks_sha256
        FROM v JOIN coded USING (n) JOIN labels_of l ON l.label IS NOT DISTINCT FROM v.label CROSS JOIN books"""


_HOST = "coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_PATH = "coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"

ORACLES = {
    "op12_vector_codes": _codes_sql(),
    "op13_decontamination": f"""
        WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item, n, array_to_string(w[t.i:t.i + n - 1], ' ') AS said
            FROM (SELECT *, least({decontamination.WORDS}, len(w)) AS n FROM items WHERE len(w) > 0), generate_series(1, len(w) - n + 1) t(i)),
        texts AS (SELECT row_number() OVER () AS d, doc_id, {_WORDS} AS w FROM documents),
        said AS (
            SELECT d, t.i, n, array_to_string(w[t.i:t.i + n - 1], ' ') AS said
            FROM texts, (SELECT DISTINCT n FROM windows), generate_series(1, len(w) - n + 1) t(i)),
        hits AS (SELECT d, i, n, item FROM said JOIN windows USING (n, said)),
        words AS (SELECT d, count(DISTINCT t.k) AS n_hit FROM (SELECT DISTINCT d, i, n FROM hits), generate_series(i, i + n - 1) t(k) GROUP BY d),
        named AS (SELECT d, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT d, item FROM hits) GROUP BY d)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM texts LEFT JOIN words USING (d) LEFT JOIN named USING (d)""",
    "op1_url_filters": f"""
        WITH rules(rhost, rpath, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for v, h, p in URL_RULES)}),
        parts AS (SELECT row_number() OVER () AS n, page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
        fits AS (
            SELECT p.n, max_by(r.rhost || r.rpath, length(r.rhost || r.rpath)) AS rule, max_by(r.v, length(r.rhost || r.rpath)) AS v
            FROM parts p JOIN rules r ON (p.host = r.rhost OR p.host LIKE '%.' || r.rhost) AND starts_with(p.path, r.rpath)
            GROUP BY p.n)
        SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.v, 'allow') AS verdict FROM parts p LEFT JOIN fits f ON f.n = p.n""",
    "op3_ngram_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents),
        s AS (
            SELECT doc_id, unnest(list_distinct(list_transform(
                generate_series(1, greatest(1, len(w) - 4)), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s
            FROM w WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
        links AS (
            SELECT a, b FROM pairs p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * p.n >= 80 * (x.n + y.n - p.n)),
        edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
        least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(l.b, w.doc_id)) AS component_id
        FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN least_of l ON l.a = w.doc_id""",
    "op5_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op10_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
        SELECT page_id, strlen(html) AS payload_bytes, translate({" || ".join(
            f"upper(to_base(CAST('0x' || substr(sha1(html), {1 + 5 * i}, 5) AS BIGINT), 32, 4))" for i in range(8)
        )}, '{warc.BASE32_DIGITS}', '{warc.BASE32}') AS payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
        FROM p""",
}
