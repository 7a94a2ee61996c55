"""Incremental ingest: files that appear below a folder enter the catalog once.

What is new below the folder is listed by tasks and added to a log, a table beside the stream's checkpoint; the stream reads
that log. So neither the listing nor the memory of what was seen goes through the driver: it holds one entry for each file of
the log, not for each file of the folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelkin.functions.paths import classify_extension
from pixelkin.operators.catalog import catalog_append, new_listing_rows, read_table, store_files
from pixelkin.plans.scan import describe
from pixelkin.schemas import FILES, LISTED
from pixelkin.session import is_empty, materialize, qualified
from pixelkin.sources import storage
from pixelkin.sources.listing import list_media
from pixelkin.sources.media import Decoder, decoded_hashes, plain_path

#: Names that Spark's file sources pass over, of files and of folders, as the stream does.
_HIDDEN = r"/(\.|_(?!(common_)?metadata)[^/=]*(/|$))|\._COPYING_(/|$)"


def _log_new(spark: SparkSession, folder: str, log: str) -> None:
    """Add the media files below ``folder`` that the log does not have yet."""
    root = qualified(spark, folder).rstrip("/")
    if not storage.exists(root):
        raise FileNotFoundError(folder)
    shown = list_media(spark, [root]).where(~F.substring("path", len(root) + 1, 1 << 30).rlike(_HIDDEN))
    # File times in milliseconds, as Spark's file sources have them.
    listed = shown.select(plain_path(F.col("path")).alias("path"), "file_size", F.date_trunc("millisecond", "modified_at").alias("modified_at"))
    known = read_table(spark, log, LISTED).select("path")
    # Paths pack so well in files that the planner would broadcast very many of them.
    fresh = materialize(listed.join(known.hint("merge"), "path", "left_anti"), "listed")
    if not (storage.exists(log) and is_empty(fresh)):
        fresh.write.mode("append").parquet(log)


def ingest(
    spark: SparkSession,
    folder: str,
    catalog_path: str,
    checkpoint: str,
    project_id: str,
    decoder: Decoder,
):
    """A query that takes everything new and stops; start it again for the next round.

    The log remembers the files that were listed, the stream's checkpoint what it has read of the log. Each batch is also
    checked against the catalog, so a batch repeated after a failure inserts nothing twice. ``folder`` is one folder, not a
    pattern; one ingest at a time works with a checkpoint.
    """
    log = f"{qualified(spark, checkpoint).rstrip('/')}/listed"
    _log_new(spark, folder, log)
    stream = spark.readStream.schema(LISTED).parquet(log)
    # Empty files are passed over, as Spark's file sources do; the log has them.
    listed = stream.where("file_size > 0").withColumn("file_type", classify_extension(F.col("path")))

    def add(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        files = read_table(session, catalog_path, FILES)
        fresh = materialize(new_listing_rows(batch.dropDuplicates(["path"]), files, project_id), "new-files")
        # A known path is never read again, so an image must get its hash now.
        hashes = decoded_hashes(fresh.where(F.col("file_type") == "image"), decoder)
        store_files(materialize(catalog_append(describe(fresh, hashes, project_id), files), "ingested"), catalog_path)

    return (
        listed.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
