"""Catalog-shaped inputs derived from the driver's tables; both engines' checks start from these."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


HASHES_SQL = """
WITH v AS (
  SELECT vec_id * 4 + k AS file_id, vec_id AS owner,
    transform(embedding, (x, i) -> CAST(CASE WHEN (i * 29 + vec_id * 11 + k * 17) % 64 < (vec_id % 5) * k
      THEN -0.25D * x ELSE CAST(x AS DOUBLE) END AS DOUBLE)) w
  FROM {embeddings} LATERAL VIEW explode(array(0, 1, 2, 3)) kk AS k),
n AS (SELECT file_id, owner, w, sqrt(aggregate(w, 0D, (a, x) -> a + x * x)) nrm FROM v)
SELECT file_id, owner, zip_with(w, array_repeat(nrm, size(w)), (x, r) -> x / r) vec,
  aggregate(transform(w, (x, i) -> CASE WHEN x <= 0 THEN 0L ELSE shiftleft(1L, 63 - i) END), 0L, (a, x) -> a | x) phash
FROM n
"""


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate hashes and vectors: four variants per embedding (file_id, owner, vec, phash)."""
    # The table is one small file; without this everything would run in one task.
    spread = table(spark, sf_dir, "embeddings").repartition(spark.sparkContext.defaultParallelism)
    return spark.sql(HASHES_SQL, embeddings=spread)


CATALOG_SQL = """
SELECT doc_id AS file_id, concat('p', doc_id % 3) AS project_id,
 concat(CASE doc_id % 4 WHEN 0 THEN '/library/' WHEN 1 THEN '/library2/' ELSE '/media/' END,
  source, '/', lang, '/', doc_id, '/IMG_', doc_id % 50, '.',
  CASE doc_id % 7 WHEN 0 THEN 'jpg' WHEN 1 THEN 'PNG' WHEN 2 THEN 'heic' WHEN 3 THEN 'mp4'
   WHEN 4 THEN 'mp3' WHEN 5 THEN 'txt' ELSE 'TIF' END) AS path,
 n_chars AS file_size, md5(text) AS md5,
 CASE doc_id % 5 WHEN 0 THEN NULL
  WHEN 1 THEN concat(2020 + doc_id % 6, '-', lpad(CAST(1 + doc_id % 12 AS VARCHAR(2)), 2, '0'), '-',
   lpad(CAST(1 + doc_id % 28 AS VARCHAR(2)), 2, '0'), 'T10:20:30')
  WHEN 2 THEN concat(2020 + doc_id % 6, '-', lpad(CAST(1 + doc_id % 12 AS VARCHAR(2)), 2, '0'), '-',
   lpad(CAST(1 + doc_id % 28 AS VARCHAR(2)), 2, '0'), 'T10:20:30.5+00:00')
  WHEN 3 THEN concat(2020 + doc_id % 6, '-', lpad(CAST(1 + doc_id % 12 AS VARCHAR(2)), 2, '0'), '-',
   lpad(CAST(1 + doc_id % 28 AS VARCHAR(2)), 2, '0'), ' 10:20:30')
  ELSE 'unknown' END AS taken_at,
 concat(2020 + doc_id % 6, ':', lpad(CAST(1 + doc_id % 12 AS VARCHAR(2)), 2, '0'), ':05 07:08:09') AS exif_raw
FROM {documents}
"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows with types, name conflicts, three date formats and content copies."""
    return spark.sql(CATALOG_SQL, documents=table(spark, sf_dir, "documents"))
