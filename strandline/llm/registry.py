"""Queries op1 to op10 over the driver tables, and the oracles that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import langid, licenses, mixing, packing, pii, quality, simhash, vectors, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.embedding_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_archive(_table(spark, sf_dir, "pages"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_inner_products(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).withColumn("rate", F.round("rate", 9)).drop("mix_key")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents with pseudonyms under the session's key; counts by kind as sorted JSON."""
    done = pii.pseudonyms(_table(spark, sf_dir, "documents"), pii.session_key(spark))
    return done.withColumn("pii_counts", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("pii_counts")))))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_digest(_table(spark, sf_dir, "documents"))


QUERIES = (
    op1_embedding_near_dedup,
    op2_warc,
    op3_quality_classifier,
    op4_license_scan,
    op5_exact_top_k,
    op6_mixing,
    op7_language_id,
    op8_pii,
    op9_simhash_near_dedup,
    op10_best_fit_packing,
)

ORACLES = {
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS hex FROM p),
g AS (SELECT hex, max(page_id) AS head FROM d GROUP BY hex),
b AS (SELECT d.*, g.head,
  list_aggregate(list_transform(range(0, 8), lambda i: CAST('0x' || substr(d.hex, 5 * i + 1, 5) AS BIGINT)), 'list') AS v FROM d JOIN g USING (hex)),
t AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda j:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v[1 + j // 4] >> (15 - 5 * (j % 4))) & 31), 1)), '') AS payload_digest FROM b)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id < head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < head THEN head END AS refers_to
FROM t
""",
    "op4_license_scan": licenses.oracle(),
    "op5_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id,
  CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op6_mixing": mixing.ORACLE,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
