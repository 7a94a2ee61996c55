"""The catalog tables: projects, roots, files, vectors, groups.

Every operator maps DataFrames to a DataFrame; writing is left to the ``store_*`` functions. First-of-key
choices are aggregates with map-side combining, so a key shared by many rows is never gathered.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelkin.functions.paths import under_dir
from pixelkin.schemas import FILES, GROUPS, conform


def file_id(project_id, path) -> F.Column:
    """Deterministic id of a file of a project."""
    return F.md5(F.concat_ws("\u0001", project_id, path))


# --- reading -----------------------------------------------------------------------------------------


def new_listing_rows(listing: DataFrame, files: DataFrame, project_id: str) -> DataFrame:
    """Listed files whose path the project's catalog does not know; known paths are never read again."""
    known = files.where(F.col("project_id") == project_id).select("path")
    # Paths pack so well in stored tables that the planner would broadcast very many of them.
    return listing.join(known.hint("merge"), "path", "left_anti")


def project_files(files: DataFrame, project_id: str) -> DataFrame:
    """Files of a project in date order, undated first."""
    return files.where(F.col("project_id") == project_id).orderBy(F.col("taken_at").asc_nulls_first(), "path")


def hash_files(files: DataFrame, project_id: str, prefix: str | None = None) -> DataFrame:
    """Hash-bearing files of a project in hash order, optionally below a folder (ignoring case)."""
    kept = files.where((F.col("project_id") == project_id) & F.col("phash").isNotNull())
    if prefix:
        kept = kept.where(under_dir(F.col("path"), prefix, ignore_case=True))
    return kept.orderBy("phash", "path")


def vector_lookup(needed: DataFrame, vectors: DataFrame) -> DataFrame:
    """Needed files with their cached vector or null."""
    found = needed.join(vectors.select("file_id", "vector"), "file_id", "left")
    return found.withColumn("vector", F.when(F.size("vector") > 0, F.col("vector")))


def project_list(projects: DataFrame) -> DataFrame:
    """Projects, newest first."""
    return projects.orderBy(F.col("created_at").desc(), "project_id")


def project_detail(projects: DataFrame, roots: DataFrame, project_id: str) -> DataFrame:
    """One project with its roots in creation order; an unknown project is an error."""
    chosen = projects.where(F.col("project_id") == project_id)
    if not chosen.take(1):
        raise LookupError(f"no such project: {project_id}")
    return project_details(chosen, roots)


def project_details(projects: DataFrame, roots: DataFrame) -> DataFrame:
    """Projects with their roots in creation order (empty when there are none)."""
    entry = F.struct("created_at", "root_id", "path")
    nested = roots.groupBy("project_id").agg(F.array_sort(F.collect_list(entry)).alias("roots"))
    joined = projects.join(nested, "project_id", "left")
    return joined.withColumn("roots", F.coalesce("roots", F.array().cast(nested.schema["roots"].dataType)))


# --- maintenance -------------------------------------------------------------------------------------


def catalog_append(incoming: DataFrame, files: DataFrame, scope: str = "global", order: list[str] | None = None) -> DataFrame:
    """Rows to insert: the first per new path.

    ``scope="global"`` treats a path as taken whatever its project; ``"project"`` keeps one row per project
    and path.
    """
    key = ["path"] if scope == "global" else ["project_id", "path"]
    fresh = incoming.join(files.select(*key).hint("merge"), key, "left_anti")
    row = F.struct(*[F.col(c) for c in incoming.columns])
    first = fresh.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(
        F.min_by(row, F.struct(*(order or ["file_id"]))).alias("_row")
    )
    return first.select("_row.*")


def one_row_per_path(files: DataFrame) -> DataFrame:
    """The row with the largest id of every path."""
    row = F.struct(*[F.col(c) for c in files.columns])
    return files.groupBy(F.col("path").alias("_path")).agg(F.max_by(row, "file_id").alias("_row")).select("_row.*")


def stale_rows(files: DataFrame, listing: DataFrame, project_id: str, target_dir: str) -> DataFrame:
    """Catalogued rows below the target whose file is gone."""
    below = files.where(
        (F.col("project_id") == project_id) & under_dir(F.col("path"), target_dir, ignore_case=True)
    )
    return below.join(listing.select("path"), "path", "left_anti")


def without_rows(files: DataFrame, gone: DataFrame, key: str = "file_id") -> DataFrame:
    return files.join(gone.select(key), key, "left_anti")


def register_roots(roots: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested roots (project_id, path, created_at) that the project does not have yet, each once."""
    fresh = requested.join(roots.select("project_id", "path"), ["project_id", "path"], "left_anti")
    fresh = fresh.groupBy("project_id", "path").agg(F.min("created_at").alias("created_at"))
    return fresh.withColumn("root_id", file_id(F.col("project_id"), F.col("path")))


def cascade_delete(projects: DataFrame, roots: DataFrame, files: DataFrame, project_id: str):
    """The three tables without a project."""
    other = F.col("project_id") != project_id
    return projects.where(other), roots.where(other), files.where(other)


# --- counts ------------------------------------------------------------------------------------------


def _type_counts(df: DataFrame) -> list:
    return [
        F.count_if(F.col("file_type") == kind).alias(name)
        for kind, name in (("image", "images"), ("video", "videos"), ("audio", "audios"))
    ]


def scan_summary(listing: DataFrame) -> DataFrame:
    """Counts over all listed files, already catalogued or not."""
    return listing.agg(F.count("*").alias("total_files"), *_type_counts(listing))


def source_type_counts(files: DataFrame, target_dir: str | None) -> DataFrame:
    """Per project: files outside the target, by type."""
    kept = files if target_dir is None else files.where(~under_dir(F.col("path"), target_dir))
    return kept.groupBy("project_id").agg(*_type_counts(kept))


# --- writing -----------------------------------------------------------------------------------------


def _file_system(spark, path: str):
    """(Hadoop file system, its path class)."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _has_data(spark, path: str) -> bool:
    system, at = _file_system(spark, path)
    return system.exists(at(path))


#: The name of a partition that is being replaced; names that begin so are not read.
_ASIDE = "_replaced-"


def _restore(spark, path: str) -> None:
    """Put back partitions that a run set aside and did not get to replace; forget those that it did."""
    system, at = _file_system(spark, path)
    for state in system.listStatus(at(path)):
        name = state.getPath().getName()
        if name.startswith(_ASIDE):
            place = at(f"{path}/{name[len(_ASIDE):]}")
            if system.exists(place):
                system.delete(state.getPath(), True)
            else:
                system.rename(state.getPath(), place)


def replace_partition(rows: DataFrame, partition: str, path: str) -> None:
    """Write ``rows`` as the partition folder ``partition`` (such as project_id=x) of the table at ``path``.

    They are written whole beside the table's data first. Then the old folder steps aside and the new one takes its name; a run
    that dies anywhere leaves the old rows or the new ones (``read_table`` puts a folder back that stepped aside in vain).
    One writer at a time.
    """
    spark = rows.sparkSession
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    rows.write.parquet(staged)
    system, at = _file_system(spark, path)
    _restore(spark, path)
    place, aside = at(f"{path}/{partition}"), at(f"{path}/{_ASIDE}{partition}")
    if system.exists(place) and not system.rename(place, aside):
        raise OSError(f"{place} cannot step aside")
    if not system.rename(at(staged), place):
        raise OSError(f"{staged} cannot take its place")
    system.delete(aside, True)


def read_table(spark, path: str, schema) -> DataFrame:
    """A stored table, or an empty one before the first write."""
    if not _has_data(spark, path):
        return spark.createDataFrame([], schema)
    _restore(spark, path)
    return conform(spark.read.schema(schema).parquet(path), schema)


def store_files(rows: DataFrame, path: str) -> None:
    """Append catalog rows, partitioned by project."""
    conform(rows, FILES).write.mode("append").partitionBy("project_id").parquet(path)


def store_groups(groups: DataFrame, project_id: str, path: str) -> None:
    """Replace the group assignment of one project; other projects stay.

    The assignment is written to the project's own partition folder, so clearing and setting is one step
    also when the project has no group any more.
    """
    rows = conform(groups.withColumn("project_id", F.lit(project_id)), GROUPS).drop("project_id")
    replace_partition(rows, f"project_id={project_id}", path)


def outside_folders(rows: DataFrame, folders: DataFrame) -> DataFrame:
    """``rows`` (path) that do not lie below any of ``folders`` (path)."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    under = rows.select("path", F.explode(above).alias("folder")).join(folders.select(F.col("path").alias("folder")), "folder", "left_semi")
    return rows.join(under.select("path").distinct(), "path", "left_anti")


def store_vectors(fresh: DataFrame, vectors: DataFrame, path: str) -> None:
    """Append vectors of files that have none yet, one per file."""
    new = fresh.where(F.size("vector") > 0).join(vectors.select("file_id"), "file_id", "left_anti")
    new = new.groupBy("file_id").agg(F.any_value("vector").alias("vector"))
    new.select("file_id", F.col("vector").cast("array<float>").alias("vector")).write.mode("append").parquet(path)
