"""Organizing: a plan of destinations first, its execution as a separate job.

The plan is one DataFrame without side effects, so it can be inspected, stored, and executed again after a
failure. All "first one wins" rules are minimum aggregates whose winner is joined back by its path, which is
unique, so neither a content nor a name shared by very many files gathers them in one task.
"""

from __future__ import annotations

from itertools import count

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelkin.functions.dates import apply_template, date_parts
from pixelkin.functions.paths import extension, file_stem, of_types, under_dir
from pixelkin.session import is_empty, materialize
from pixelkin.sources import storage

READY = "ready"
SKIP_MISSING, SKIP_CONTENT, SKIP_UNDATED, SKIP_DATE = "source_missing", "same_content", "no_date", "bad_date"
DONE, FAILED, SKIPPED = "success", "failed", "skipped"
DEST_EXISTS, DEST_IS_SOURCE = "destination_exists", "destination_is_source"


def _order() -> Column:
    """Date order, undated first, then path."""
    return F.struct(F.col("taken_at").isNotNull().alias("dated"), F.coalesce("taken_at", F.lit("")).alias("at"), "path")


def not_in_target(files: DataFrame, target_files: DataFrame) -> DataFrame:
    """Files (or claims) whose content the target does not have; one without MD5 is always kept."""
    present = target_files.where(F.col("md5").isNotNull()).select("md5").distinct()
    return files.join(present, "md5", "left_anti")


def existing_sources(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Files that are still on disk."""
    return files.join(listing.select("path"), "path", "left_semi")


def content_claims(files: DataFrame) -> DataFrame:
    """(md5, claim_path): the file that claims a content, first in date order whether it is usable or not."""
    known = files.where(F.col("md5").isNotNull())
    return known.groupBy("md5").agg(F.min(_order()).alias("_first")).select("md5", F.col("_first.path").alias("claim_path"))


def _first_of(df: DataFrame, column: str) -> DataFrame:
    """(column, owner): the first row, in organizing order, that asks for a value."""
    return df.groupBy(column).agg(F.min("_order").alias("_first")).select(column, F.col("_first.path").alias("owner"))


def resolve_conflicts(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """``wanted`` (path, taken_at, dest_dir, file_name, ...) with a free ``dest_path`` each.

    The first file asking for a name gets it unless the name exists on disk. The others get the stem with
    six hex digits of their path's digest; the few that still collide get a whole digest, another one each round,
    until every name is free.
    """
    ext = F.regexp_extract("file_name", r"[^/]\.([^./]*)$", 1)
    stem = F.when(ext == "", F.col("file_name")).otherwise(file_stem(F.col("file_name")))
    tail = F.when(ext == "", F.lit("")).otherwise(F.concat(F.lit("."), ext))

    def renamed(attempt: int) -> Column:
        digest = F.md5("path") if attempt < 2 else F.md5(F.concat_ws(":", "path", F.lit(attempt - 1)))
        shown = F.substring(digest, 1, 6) if attempt == 0 else digest
        return F.concat(F.col("dest_dir"), F.lit("/"), stem, F.lit("_"), shown, tail)

    columns = [*wanted.columns, "dest_path"]
    taken = existing.select(F.col("path").alias("dest_path"))
    rest = wanted.withColumn("_order", _order()).withColumn("dest_path", F.concat_ws("/", "dest_dir", "file_name"))
    settled = None
    for attempt in count():
        owners = _first_of(rest, "dest_path").join(taken, "dest_path", "left_anti")
        owners = owners.select(F.col("owner").alias("path"), F.lit(True).alias("_own"))
        decided = rest.join(owners, "path", "left").withColumn("_own", F.col("_own").isNotNull())
        decided = materialize(decided, "destinations")
        won = decided.where("_own").select(*columns)
        settled = won if settled is None else settled.unionByName(won)
        rest = decided.where(~F.col("_own")).drop("_own")
        if is_empty(rest):
            return settled
        taken = taken.unionByName(won.select("dest_path"))
        rest = rest.withColumn("dest_path", renamed(attempt))


def organize_plan(
    files: DataFrame,
    listing: DataFrame,
    target_dir: str,
    template: str = "YYYY/MM/DD",
    mode: str = "copy",
    file_types: list[str] | None = None,
) -> DataFrame:
    """(file_id, path, action, status, skip_reason, dest_path) for every source file of the wanted types.

    ``files`` is the catalog of one project, sources and target together; ``listing`` (path) is what exists
    on disk. A content claimed by an earlier file is skipped even when that file turns out to be unusable.
    """
    base = target_dir.replace("\\", "/")
    present = listing.select("path").distinct().withColumn("_there", F.lit(True))
    inside = under_dir(F.col("path"), base)
    target = existing_sources(files.where(inside), listing)
    source = files.where(~inside).where(of_types(F.col("file_type"), file_types)).join(present, "path", "left")
    # One row per content on both sides of this join; the winners then go back to the files by path.
    claims = not_in_target(content_claims(source.where("_there")), target)
    winners = claims.select(F.col("claim_path").alias("path"), F.lit(True).alias("_wins"))
    judged = source.join(winners, "path", "left")
    parts = date_parts(F.col("taken_at"))
    reason = (
        F.when(F.col("_there").isNull(), SKIP_MISSING)
        .when(F.col("md5").isNotNull() & F.col("_wins").isNull(), SKIP_CONTENT)
        .when(F.col("taken_at").isNull(), SKIP_UNDATED)
        .when(parts.isNull(), SKIP_DATE)
    )
    folder = F.concat(F.lit(base.rstrip("/") + "/"), apply_template(template, parts))
    judged = judged.select(
        "file_id", "path", "file_name", "taken_at", reason.alias("skip_reason"), folder.alias("dest_dir")
    )
    judged = materialize(judged, "organize")
    ready = resolve_conflicts(judged.where(F.col("skip_reason").isNull()).drop("skip_reason"), listing)
    ready = ready.select("file_id", "path", F.lit(None).cast("string").alias("skip_reason"), "dest_path")
    skipped = judged.where(F.col("skip_reason").isNotNull()).select(
        "file_id", "path", "skip_reason", F.lit(None).cast("string").alias("dest_path")
    )
    return ready.unionByName(skipped).select(
        "file_id",
        "path",
        F.lit("move" if mode == "move" else "copy").alias("action"),
        F.when(F.col("skip_reason").isNull(), READY).otherwise(SKIPPED).alias("status"),
        "skip_reason",
        "dest_path",
    )


def _transfer(source: str, dest: str, move: bool) -> str | None:
    """Copy or move one file; None, or why it was not done. Never touches a file that is there and not the same.

    A destination that is the source under another name (a link to it, other slashes) is left alone, and so is any link: the
    file behind it may be the only one. A file of its own with the source's size and MD5 is an earlier attempt. A moved
    source is gone when its task runs again; only then does its absence count as success.
    """
    if storage.same_place(source, dest):
        return None if source == dest else DEST_IS_SOURCE
    if storage.is_link(dest):
        return DEST_EXISTS
    if not storage.exists(source):
        again = move and TaskContext.get().attemptNumber() > 0 and storage.exists(dest)
        return None if again else SKIP_MISSING
    try:
        # A second name of a link would be a link again.
        storage.place(source, dest, move and not storage.is_link(source))
    except FileExistsError:
        if not storage.same_content(source, dest):
            return DEST_EXISTS
    if move:
        storage.remove(source)
    return None


def execute_organize(plan: DataFrame) -> DataFrame:
    """Carry out the ready rows of a plan -> status rows (file_id, path, dest_path, status, skip_reason).

    Destinations of a plan are distinct, so tasks never touch the same file, and a file that is there already, whatever
    the plan knew, is never overwritten. The status is written once.
    """

    def run(batches):
        for batch in batches:
            states, notes = [], []
            for row in batch.itertuples(index=False):
                if row.status != READY:
                    states.append(SKIPPED)
                    notes.append(row.skip_reason)
                    continue
                try:
                    reason = _transfer(row.path, row.dest_path, row.action == "move")
                    states.append(DONE if reason is None else FAILED)
                    notes.append(reason)
                except OSError as error:
                    states.append(FAILED)
                    notes.append(type(error).__name__)
            yield pd.DataFrame(
                {
                    "file_id": batch["file_id"],
                    "path": batch["path"],
                    "dest_path": batch["dest_path"],
                    "status": pd.Series(states, dtype=object, index=batch.index),
                    "skip_reason": pd.Series(notes, dtype=object, index=batch.index),
                }
            )

    schema = "file_id string, path string, dest_path string, status string, skip_reason string"
    # The plan is fixed in a table first: planning again while files move would see another disk.
    fixed = storage.spread(materialize(plan, "plan"))
    return materialize(fixed.mapInPandas(run, schema), "organize-status")


def organize_summary(rows: DataFrame) -> DataFrame:
    """Totals of a plan or of its status rows; a failed transfer counts as skipped."""
    good = F.col("status").isin(READY, DONE)
    return rows.agg(
        F.count("*").alias("total"), F.count_if(good).alias("success"), F.count_if(~good).alias("skipped")
    )


def skip_reasons(rows: DataFrame) -> DataFrame:
    """Skipped rows per reason."""
    return rows.where(F.col("skip_reason").isNotNull()).groupBy("skip_reason").agg(F.count("*").alias("files"))
