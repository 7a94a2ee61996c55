"""The three jobs that users run, from stored tables to stored tables: find duplicates, organize, delete.

Each reads the catalog, brings it up to date with the disk, calls the operators and stores what they return. A second
run on an unchanged disk changes nothing.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelkin.config import DedupConfig
from pixelkin.operators import catalog
from pixelkin.plans import deletes, organize
from pixelkin.plans.dedup import PHASH_AI, DedupRun, Embedder, dedup
from pixelkin.plans.scan import scan
from pixelkin.schemas import FILES, VECTORS, conform
from pixelkin.session import materialize
from pixelkin.sources.listing import list_media, list_media_and_closed
from pixelkin.sources.media import Decoder


@dataclass(frozen=True)
class Store:
    """Where the tables of a catalog lie."""

    folder: str

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def files(self, spark: SparkSession) -> DataFrame:
        return catalog.read_table(spark, self.path("files"), FILES)

    def vectors(self, spark: SparkSession) -> DataFrame:
        return catalog.read_table(spark, self.path("vectors"), VECTORS)

    def replace_files(self, rows: DataFrame, project_id: str) -> None:
        """One project's rows in place of what it had; they are written elsewhere first, as they come from that table."""
        kept = materialize(conform(rows, FILES).drop("project_id"), "kept-files")
        catalog.replace_partition(kept, f"project_id={project_id}", self.path("files"))


def _drop_stale(spark: SparkSession, store: Store, project_id: str, target_dir: str) -> DataFrame:
    """Forget files below the target that are gone from the disk; the folders (path) that could not be read.

    What lies below such a folder may well be there and is kept.
    """
    files = store.files(spark)
    listed, closed = list_media_and_closed(spark, [target_dir])
    closed = materialize(closed, "closed-folders")
    gone = catalog.outside_folders(catalog.stale_rows(files, listed, project_id, target_dir), closed)
    gone = materialize(gone.select("file_id"), "stale")
    if gone.take(1):
        mine = files.where(F.col("project_id") == project_id)
        store.replace_files(mine.join(gone, "file_id", "left_anti"), project_id)
    return closed


def _rescan(spark: SparkSession, store: Store, project_id: str, roots: list[str], decoder: Decoder | None) -> DataFrame:
    """Add what is new below the roots; the counts of all that is listed."""
    rows, summary = scan(spark, roots, store.files(spark), project_id, decoder)
    catalog.store_files(rows, store.path("files"))
    return summary


def find_duplicates(
    spark: SparkSession,
    store: Store,
    project_id: str,
    target_dir: str | None,
    mode: str = PHASH_AI,
    cfg: DedupConfig = DedupConfig(),
    decoder: Decoder | None = None,
    embedder: Embedder | None = None,
) -> DedupRun:
    """Bring the target up to date, group its near-duplicates, store groups and new vectors."""
    started = time.monotonic()
    closed = None
    if target_dir:
        closed = _drop_stale(spark, store, project_id, target_dir)
        _rescan(spark, store, project_id, [target_dir], decoder)
    scan_ms = int((time.monotonic() - started) * 1000)
    files = catalog.hash_files(store.files(spark), project_id, target_dir)
    vectors = store.vectors(spark)
    run = dedup(files, vectors if embedder is not None or vectors.take(1) else None, mode, cfg, target_dir, embedder)
    catalog.store_groups(run.groups, project_id, store.path("groups"))
    if run.new_vectors is not None:
        catalog.store_vectors(run.new_vectors, vectors, store.path("vectors"))
    # A handful of stages, the total last.
    stages = [(r["name"], r["duration_ms"] + (scan_ms if r["name"] == "total" else 0)) for r in run.timings.collect()]
    return replace(run, closed_folders=closed, timings=spark.createDataFrame([("scan", scan_ms), *stages], run.timings.schema))


def organize_project(
    spark: SparkSession,
    store: Store,
    project_id: str,
    roots: list[str],
    target_dir: str,
    template: str = "YYYY/MM/DD",
    mode: str = "copy",
    file_types: list[str] | None = None,
    decoder: Decoder | None = None,
) -> DataFrame:
    """Rescan the sources, forget lost target files, plan, and carry the plan out; its status rows."""
    _rescan(spark, store, project_id, roots, decoder)
    _drop_stale(spark, store, project_id, target_dir)
    listing = materialize(list_media(spark, [*roots, target_dir]), "listing")
    files = store.files(spark).where(F.col("project_id") == project_id)
    return organize.execute_organize(organize.organize_plan(files, listing, target_dir, template, mode, file_types))


def delete_files(spark: SparkSession, store: Store, doomed: DataFrame, target_dir: str) -> tuple[DataFrame, int]:
    """Delete the files of ``doomed`` (path) below the target: (status rows, number of catalog rows removed)."""
    status = deletes.execute_deletes(doomed, target_dir, dry_run=False)
    files = store.files(spark)
    left = deletes.catalog_after_deletes(files, status)
    counts = files.groupBy("project_id").agg(F.count("*").alias("n")).join(
        left.groupBy("project_id").agg(F.count("*").alias("m")), "project_id", "left"
    )
    # One row for each project that loses files.
    changed = counts.withColumn("m", F.coalesce("m", F.lit(0))).where("n <> m").collect()
    for r in changed:
        store.replace_files(left.where(F.col("project_id") == r["project_id"]), r["project_id"])
    return status, sum(r["n"] - r["m"] for r in changed)
