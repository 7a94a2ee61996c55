"""Guarded deletion: only below the target, dry run unless told otherwise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelkin.functions.paths import under_dir
from pixelkin.session import materialize
from pixelkin.sources import storage

WOULD_DELETE, DELETED, ABSENT, FAILED, OUTSIDE = "would_delete", "deleted", "absent", "failed", "outside_target"


def delete_plan(doomed: DataFrame, target_dir: str) -> DataFrame:
    """(path, allowed): distinct paths to delete and whether they lie below the target folder, without steps upwards."""
    inside = under_dir(F.col("path"), target_dir, boundary=True) & ~F.col("path").rlike(r"(^|[/\\])\.\.([/\\]|$)")
    return doomed.select("path").distinct().withColumn("allowed", inside)


def execute_deletes(doomed: DataFrame, target_dir: str, dry_run: bool = True) -> DataFrame:
    """Status rows (path, status). A file that is already gone counts as done, so a repeated task is harmless."""

    def run(batches):
        for batch in batches:
            states = []
            for path, allowed in zip(batch["path"], batch["allowed"]):
                if not allowed:
                    states.append(OUTSIDE)
                elif dry_run:
                    states.append(WOULD_DELETE)
                elif not storage.exists(path):
                    states.append(ABSENT)
                else:
                    try:
                        storage.remove(path)
                        states.append(DELETED)
                    except OSError:
                        states.append(FAILED)
            yield pd.DataFrame({"path": batch["path"], "status": pd.Series(states, dtype=object, index=batch.index)})

    plan = materialize(delete_plan(doomed, target_dir), "delete-plan")
    return materialize(storage.spread(plan).mapInPandas(run, "path string, status string"), "delete-status")


def catalog_after_deletes(files: DataFrame, status: DataFrame) -> DataFrame:
    """The catalog without the rows, of any project, whose file was removed or already absent."""
    gone = status.where(F.col("status").isin(DELETED, ABSENT)).select("path")
    return files.join(gone, "path", "left_anti")
