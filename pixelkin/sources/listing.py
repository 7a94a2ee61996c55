"""Recursive listing of media files as breadth-first Spark jobs.

Spark's own file sources leave out names that start with an underscore or a dot, which many cameras use,
so folders are walked here: one job per folder depth, all folders of a depth in parallel.
"""

from __future__ import annotations

import os

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelkin.functions.paths import classify_extension, file_name
from pixelkin.session import is_empty, materialize
from pixelkin.sources import storage

_ENTRY = "root string, path string, is_dir boolean, file_size long, modified_us long"
_BATCH = 10_000


def _loops(path: str) -> bool:
    """A link to a folder that the walked path has come through, under whatever name."""
    if not os.path.islink(path):
        return False
    target, above = os.path.realpath(path), os.path.dirname(path)
    while True:
        if os.path.realpath(above) == target:
            return True
        if above in ("", "/"):
            return False
        above = os.path.dirname(above)


def _local_entries(folder: str):
    """Entries of a local folder one by one, however many there are."""
    try:
        with os.scandir(folder) as found:
            for entry in found:
                try:
                    is_dir = entry.is_dir()
                    if is_dir and _loops(entry.path):
                        continue
                    state = entry.stat()
                except FileNotFoundError:
                    continue  # A dangling link, or gone meanwhile.
                except OSError:
                    yield entry.path, None, 0, None
                    continue
                yield entry.path, is_dir, 0 if is_dir else state.st_size, state.st_mtime_ns // 1000
    except (FileNotFoundError, PermissionError):
        yield folder, None, 0, None


def _entries(folder: str):
    system, inner = storage.locate(folder)
    prefix = folder[: len(folder) - len(inner)] if folder.endswith(inner) else ""
    if isinstance(system, fs.LocalFileSystem):
        for path, *rest in _local_entries(inner):
            yield (prefix + path, *rest)
        return
    try:
        found = system.get_file_info(fs.FileSelector(inner, recursive=False))
    except (FileNotFoundError, PermissionError):
        # Gone meanwhile, or closed to us: reported. Any other fault of the storage fails the task.
        yield folder, None, 0, None
        return
    for info in found:
        is_dir = info.type == fs.FileType.Directory
        if info.type == fs.FileType.NotFound or (is_dir and not prefix and _loops(info.path)):
            continue
        stamp = None if info.mtime_ns is None else info.mtime_ns // 1000
        yield prefix + info.path, is_dir, int(info.size or 0), stamp


def _list_folders(batches):
    names = ["root", "path", "is_dir", "file_size", "modified_us"]
    rows = []
    for batch in batches:
        for root, folder in zip(batch["root"], batch["path"]):
            for entry in _entries(folder):
                rows.append((root, *entry))
                if len(rows) >= _BATCH:
                    yield pd.DataFrame(rows, columns=names).astype({"modified_us": "Int64", "is_dir": "boolean"})
                    rows = []
    if rows:
        yield pd.DataFrame(rows, columns=names).astype({"modified_us": "Int64", "is_dir": "boolean"})


def walk(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Every file below each root (root, path, file_size, modified_us); missing roots are passed over.

    A file below two overlapping roots is listed once per root.
    """
    return walk_folders(spark, roots)[0]


def walk_folders(spark: SparkSession, roots: list[str]) -> tuple[DataFrame, DataFrame]:
    """(files as ``walk`` lists them, folders (root, path) that could not be read)."""
    present = [r.rstrip("/") or "/" for r in roots if storage.exists(r)]
    frontier = spark.createDataFrame([(r, r) for r in present], "root string, path string")
    files = closed = None
    width = spark.sparkContext.defaultParallelism
    while True:
        level = materialize(frontier.repartition(width).mapInPandas(_list_folders, _ENTRY), "listing")
        found = level.where(~F.col("is_dir")).drop("is_dir")
        files = found if files is None else files.unionByName(found)
        shut = level.where(F.col("is_dir").isNull()).select("root", "path")
        closed = shut if closed is None else closed.unionByName(shut)
        frontier = level.where("is_dir").select("root", "path")
        if is_empty(frontier):
            return files, closed


def list_media(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Media files below the roots (path, file_name, file_size, modified_at, file_type)."""
    return list_media_and_closed(spark, roots)[0]


def list_media_and_closed(spark: SparkSession, roots: list[str]) -> tuple[DataFrame, DataFrame]:
    """(media files as ``list_media`` has them, folders (path) that could not be read)."""
    found, closed = walk_folders(spark, roots)
    return _media(found), closed.select("path").distinct()


def _media(found: DataFrame) -> DataFrame:
    typed = found.withColumn("file_type", classify_extension(F.col("path")))
    return typed.where(F.col("file_type").isNotNull()).select(
        "path",
        file_name(F.col("path")).alias("file_name"),
        "file_size",
        F.timestamp_micros("modified_us").alias("modified_at"),
        "file_type",
    )


def list_roots(spark: SparkSession, roots: DataFrame, project_id: str) -> DataFrame:
    """Media files below all roots of a project; the table of roots is small user input."""
    paths = [r.path for r in roots.where(F.col("project_id") == project_id).orderBy("created_at").collect()]
    return list_media(spark, paths)
