"""From raw documents to packed training sequences: quality, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of ``docs``. Rows that share an id, or have none,
are judged row by row.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelkin.llm import host_quality, ngram_join, queries, secret_scan, vector_packing
from pixelkin.session import materialize, scratch_dir

_FILE, _AT = "_row_file", "_row_at"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor their host's verdict rejects."""
    # Stored once: hosts are counted from it, and a filter cannot repeat the measures.
    scored = materialize(host_quality.measured(docs), "measured")
    return host_quality.judged(scored).where("_kept").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that near-duplicate links connect, exactly one: the one with the smallest id, then the first stored.

    A row is told from all others by its place in the stored input, so equal ids and missing ones do not matter; a row
    without an id stays only where its group has no id at all. Rows with an empty set link with nothing and stay.
    Groups are few against all documents; only the rows that go are looked up.
    """
    placed = _placed(docs)
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), _FILE, _AT)
    groups = materialize(ngram_join.jaccard_join(placed.select(row.alias("doc_id"), "text")), "groups")
    gone = groups.where("doc_id <> component_id").select(f"doc_id.{_FILE}", f"doc_id.{_AT}")
    return placed.join(materialize(gone, "gone"), [_FILE, _AT], "left_anti").select(*docs.columns)


def _placed(docs: DataFrame) -> DataFrame:
    """``docs`` with the file and the number of every row; stored first unless read from parquet files as it is."""
    try:
        place = docs.metadataColumn("_metadata")
        return docs.select("*", place["file_path"].alias(_FILE), place["row_index"].alias(_AT))
    except AnalysisException:
        return _placed(materialize(docs, "documents"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced, and ``n_chars`` counted again where it changed."""
    clean = secret_scan.redacted(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return clean.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of every document and their places in sequences."""
    return vector_packing.pack(
        docs,
        queries.RANKS_FILE,
        queries.SPECIAL,
        queries.END_ID,
        vector_packing.Capacity(tokens=1024),
        {"ids_crc32": ("long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))},
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_join", one_of_each_group),
    ("secret_scan", without_secrets),
    ("vector_packing", packed),
]

#: Tokens and randomness tests are beyond SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each reading what the one before has written."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{scratch_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
