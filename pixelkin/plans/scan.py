"""Scanning: list, keep what is new, read only that, and hand out catalog rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelkin.functions.dates import taken_at
from pixelkin.functions.paths import classify_extension, file_name
from pixelkin.operators.catalog import catalog_append, file_id, new_listing_rows, scan_summary
from pixelkin.schemas import FILES, conform
from pixelkin.session import materialize
from pixelkin.sources.listing import list_media
from pixelkin.sources.media import Decoder, decoded_hashes, image_hashes, new_images, read_contents


def describe(new_files: DataFrame, hashes: DataFrame, project_id: str) -> DataFrame:
    """Catalog rows of ``new_files`` (path, file_size, modified_at); ``hashes`` (path, phash) of the images."""
    contents = read_contents(new_files)
    # As many rows as files on every side: a stored listing is small, what it holds is not, so nothing is broadcast.
    rows = new_files.join(contents.hint("merge"), "path").join(hashes.hint("merge"), "path", "left")
    kind = classify_extension(F.col("path"))
    return conform(
        rows.select(
            file_id(F.lit(project_id), F.col("path")).alias("file_id"),
            F.lit(project_id).alias("project_id"),
            "path",
            file_name(F.col("path")).alias("file_name"),
            "file_size",
            kind.alias("file_type"),
            taken_at(kind, F.col("exif_raw"), F.col("modified_at")).alias("taken_at"),
            F.when(kind == "image", F.col("phash")).alias("phash"),
            "md5",
            F.current_timestamp().alias("created_at"),
        ),
        FILES,
    )


def scan(
    spark: SparkSession,
    roots: list[str],
    files: DataFrame,
    project_id: str,
    decoder: Decoder | None = None,
    scope: str = "global",
) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, summary of everything listed).

    Without ``decoder`` pixels come from Spark's image source, which leaves out names with a leading dot or underscore. Only
    new images are decoded, but for a first scan of many (``media.new_images``).
    """
    listing = materialize(list_media(spark, roots), "listing")
    fresh = new_listing_rows(listing, files, project_id).groupBy("path").agg(
        F.max("file_size").alias("file_size"),
        F.max("modified_at").alias("modified_at"),
        F.max("file_type").alias("file_type"),
    )
    fresh = materialize(fresh, "new-files")
    pictures = fresh.where(F.col("file_type") == "image")
    if decoder is not None:
        hashes = decoded_hashes(pictures, decoder)
    elif pictures.take(1):
        hashes = image_hashes(new_images(spark, roots, pictures))
    else:
        hashes = spark.createDataFrame([], "path string, phash long")
    rows = describe(fresh, hashes.groupBy("path").agg(F.max("phash").alias("phash")), project_id)
    return materialize(catalog_append(rows, files, scope), "scanned"), scan_summary(listing)
