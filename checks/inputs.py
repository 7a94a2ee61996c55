"""Catalog-shaped inputs of the registered queries, all derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelkin import fixtures
from pixelkin.functions.paths import classify_extension, file_name
from pixelkin.operators.review import DELETE_ALL, KEEP_ALL, KEEP_ONLY, SKIP_BELOW, TOGGLE
from pixelkin.session import materialize

TARGET = "/library"


def near_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files with hashes and vectors; the variants of every fifth owner are byte-equal copies."""
    rows = fixtures.hashes(spark, sf).selectExpr(
        "CAST(file_id AS STRING) AS file_id",
        "owner",
        "concat('/library/', lpad(CAST(file_id AS STRING), 9, '0'), '.jpg') AS path",
        "phash",
        "md5(CASE WHEN owner % 5 = 0 THEN concat('o', owner) ELSE concat('f', file_id) END) AS md5",
        "vec AS vector",
    )
    # Stored once, because the queries read it several times.
    return materialize(rows, "near-files")


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog rows of the media files; text files are not media and drop out."""
    rows = fixtures.catalog(spark, sf)
    typed = rows.withColumn("file_type", classify_extension(F.col("path")))
    return typed.where(F.col("file_type").isNotNull()).withColumn("file_name", file_name(F.col("path")))


def listing(spark: SparkSession, sf: str) -> DataFrame:
    """What exists on disk: some catalogued files vanished, some new ones appeared."""
    rows = catalog(spark, sf).select("file_id", "path", "file_size", "file_type")
    kept = rows.where("file_id % 9 <> 0").select("path", "file_size", "file_type")
    new = rows.where("file_id % 11 = 0").select(
        F.concat(F.lit("/media/new/"), F.col("file_id") + 1000000, F.lit(".jpg")).alias("path"),
        "file_size",
        F.lit("image").alias("file_type"),
    )
    return kept.unionByName(new)


def projects(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.table(spark, sf, "customer").selectExpr(
        "CAST(c_custkey AS STRING) AS project_id",
        "c_name AS name",
        "timestamp_seconds(1500000000 + (c_custkey * 7919) % 100003) AS created_at",
    )


def roots(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.table(spark, sf, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS root_id",
        "CAST(o_custkey AS STRING) AS project_id",
        "concat('/vol/', o_orderpriority, '/', o_orderkey % 3) AS path",
        "CAST(o_orderdate AS TIMESTAMP) AS created_at",
    )


def content_groups(spark: SparkSession, sf: str) -> DataFrame:
    """(file_id, group_id): files of one content, the group named by its smallest file id."""
    rows = catalog(spark, sf)
    heads = rows.groupBy("md5").agg(F.min("file_id").alias("head"), F.count("*").alias("n")).where("n >= 2")
    return rows.join(heads, "md5").select("file_id", F.lpad(F.col("head").cast("string"), 12, "0").alias("group_id"))


def actions(spark: SparkSession, sf: str, ordinals: DataFrame, groups: DataFrame) -> DataFrame:
    """Review clicks: one per event, on the group with the user's number."""
    picks = groups.groupBy("group_id").agg(
        *[F.min(F.when(F.col("file_id") % 3 == r, F.col("file_id"))).alias(f"m{r}") for r in range(3)],
        F.min("file_id").alias("m"),
    )
    picks = picks.join(ordinals, "group_id")
    events = fixtures.table(spark, sf, "events").select("event_id", "user_id", "event_type")
    kind = (
        F.when(F.col("event_type") == "click", KEEP_ONLY)
        .when(F.col("event_type") == "view", TOGGLE)
        .when(F.col("event_type") == "purchase", KEEP_ALL)
        .when(F.col("event_type") == "error", DELETE_ALL)
        .otherwise(SKIP_BELOW)
    )
    chosen = F.coalesce(
        F.when(F.col("event_id") % 3 == 0, F.col("m0")).when(F.col("event_id") % 3 == 1, F.col("m1")).otherwise(F.col("m2")),
        F.col("m"),
    )
    return events.join(picks, F.col("user_id") == F.col("group_ordinal")).select(
        "group_ordinal",
        F.when(kind.isin(KEEP_ONLY, TOGGLE), chosen).alias("file_id"),
        kind.alias("action"),
        F.col("event_id").alias("seq"),
    )
