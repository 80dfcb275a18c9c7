"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kotoflow.llm import decontaminate, html_extract, language_id, licences, lm_scoring, near_dup, packing, secret_scan, token_store, topk_search
from kotoflow.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every whole text."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs)
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best integer inner products of every 50th vector among all others."""
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document: its own notice, or that of the nearest licence file above its path.

    ``documents`` has no paths: a document counts as file ``<doc_id>.txt`` of folder ``<source>``.
    """
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licences.scan(docs, path).select("doc_id", "path", "licence", "score", "coverage", "found_by", "licence_dir")


#: Target ids that may be broadcast to the counting scan.
TARGET_BROADCAST = 4_000_000


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document: documents labelled good against all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("good_id")).distinct()
    side = F.broadcast(good) if good.count() <= TARGET_BROADCAST else good
    marked = docs.join(side, docs["doc_id"] == F.col("good_id"), "left")
    return lm_scoring.score(marked, F.col("good_id").isNotNull())


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id shards with Elias-Fano borders, written and read back."""
    return token_store.token_store(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into 1024-token sequences."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words found in documents."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credential candidates of every whole text, scored; values as digests."""
    found = secret_scan.findings(table(spark, sf_dir, "documents"), F.col("source"))
    return found.select("doc_id", "start", "n_chars", "kind", F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return near_dup.components(table(spark, sf_dir, "documents"), shingle=3, num=85, den=100)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_top_k": op2_top_k,
    "op3_html_text": op3_html_text,
    "op4_licences": op4_licences,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_token_ids": op6_token_ids,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_decontamination": op8_decontamination,
    "op9_secret_scan": op9_secret_scan,
    "op10_near_duplicates": op10_near_duplicates,
}

_OP8_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
window_of AS (
  SELECT DISTINCT item_id, m, array_to_string(w[k : k + m - 1], ' ') AS pattern
  FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM item WHERE len(w) > 0)),
place AS (
  SELECT doc_id, m, k, array_to_string(w[k : k + m - 1], ' ') AS pattern
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM doc, (SELECT DISTINCT m FROM window_of) WHERE len(w) >= m)),
hit AS (SELECT p.doc_id, p.m, p.k, x.item_id FROM place p JOIN window_of x ON x.m = p.m AND x.pattern = p.pattern),
word_hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(k, k + m)) AS pos FROM (SELECT DISTINCT doc_id, m, k FROM hit)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(name, ',' ORDER BY name)) AS digest
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, coalesce(i.digest, sha256('')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN word_hit h USING (doc_id) LEFT JOIN items i USING (doc_id)
"""

_OP10_SQL = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
  WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM doc UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
component AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM doc d JOIN component c USING (doc_id) LEFT JOIN size z USING (doc_id)
"""

_OP2_SQL = r"""
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND NOT list_contains([coalesce(isfinite(x), false) FOR x IN embedding], false)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([a[1] * a[2] FOR a IN list_zip(q.e, c.e)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

ORACLE_SQL: dict[str, str] = {"op2_top_k": _OP2_SQL, "op4_licences": licences.oracle_sql(), "op8_decontamination": _OP8_SQL, "op10_near_duplicates": _OP10_SQL}
