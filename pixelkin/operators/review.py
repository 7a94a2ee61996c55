"""Review of groups: listing, recommended keeper, decisions from an action log, what they free."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelkin.functions.paths import relative_folder
from pixelkin.operators.ordinals import with_ordinal
from pixelkin.operators.skew import keyed_join
from pixelkin.session import materialize

KEEP_ONLY, TOGGLE, KEEP_ALL, DELETE_ALL, SKIP_BELOW = "keep_only", "toggle", "keep_all", "delete_all", "skip_below"
_BLOCK = 4096


def keepers(members: DataFrame) -> DataFrame:
    """(group_id, file_id): the recommended file per group, the largest, then the first by path."""
    best = members.groupBy("group_id").agg(
        F.min(F.struct(F.negative("file_size").alias("s"), F.col("path").alias("p"), F.col("file_id").alias("f"))).alias("b")
    )
    return best.select("group_id", F.col("b.f").alias("file_id"))


def group_members(groups: DataFrame, files: DataFrame) -> DataFrame:
    """Files of groups that still have two or more of them, with the group's size and the keeper flag."""
    rows = materialize(files.join(groups.select("file_id", "group_id"), "file_id"), "group-files")
    sizes = rows.groupBy("group_id").agg(F.count("*").alias("group_size")).where("group_size >= 2")
    shown = keyed_join(rows, materialize(sizes, "group-sizes"), "group_id", "group_size")
    best = keepers(rows).select("file_id", F.lit(True).alias("_best"))
    return shown.join(best, "file_id", "left").withColumn("recommended", F.col("_best").isNotNull()).drop("_best")


def group_listing(groups: DataFrame, files: DataFrame) -> DataFrame:
    """Groups in id order, their files from the largest down."""
    return group_members(groups, files).orderBy("group_id", F.col("file_size").desc(), "path")


def group_ordinals(groups: DataFrame, order: str = "group_id") -> DataFrame:
    """(group_id, group_ordinal) of groups with two or more files, in the order of a group attribute."""
    keys = ["group_id"] if order == "group_id" else ["group_id", order]
    sizes = groups.groupBy(*keys).agg(F.count("*").alias("n")).where("n >= 2").drop("n")
    return with_ordinal(sizes, [order], "group_ordinal").select("group_id", "group_ordinal")


def _last_skip(actions: DataFrame, ordinals: DataFrame) -> DataFrame:
    """(group_ordinal, skip_seq): the latest skip whose starting group is at or before each group.

    A running maximum over the group numbers in two levels: inside blocks of fixed length, and over the
    block maxima. No join of groups with thresholds, no single ordered task over all groups.
    """
    skips = actions.where(F.col("action") == SKIP_BELOW).groupBy("group_ordinal").agg(F.max("seq").alias("s"))
    marked = ordinals.select("group_ordinal").join(skips, "group_ordinal", "full")
    marked = marked.withColumn("block", F.floor(F.col("group_ordinal") / _BLOCK))
    inside = Window.partitionBy("block").orderBy("group_ordinal")
    marked = marked.withColumn("near", F.max("s").over(inside))
    # One row per 4096 groups.
    blocks = marked.groupBy("block").agg(F.max("s").alias("s"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.max("s").over(before).alias("far"))
    joined = marked.join(blocks, "block")
    return joined.select("group_ordinal", F.greatest("near", "far").alias("skip_seq"))


def decide(members: DataFrame, ordinals: DataFrame, actions: DataFrame) -> DataFrame:
    """(group_id, file_id, file_size, keep) after replaying the action log.

    ``members``: (group_id, file_id, file_size, path); ``actions``: (group_ordinal, file_id, action, seq).
    The last action on a whole group sets the state, toggles of a file after it flip the file. Actions on
    groups that do not exist change nothing.
    """
    members = materialize(members.select("group_id", "file_id", "file_size", "path"), "review-members")
    sizes = members.groupBy("group_id").agg(F.count("*").alias("n"))
    ordinals = materialize(ordinals.join(sizes, "group_id"), "ordinals")
    best = keepers(members).select("file_id", F.lit(True).alias("_best"))
    whole = actions.where(F.col("action").isin(KEEP_ONLY, KEEP_ALL, DELETE_ALL))
    last = whole.groupBy("group_ordinal").agg(F.max(F.struct("seq", "action", "file_id")).alias("l"))
    states = ordinals.join(last, "group_ordinal", "left").join(_last_skip(actions, ordinals), "group_ordinal", "left")
    skipped = F.coalesce(F.col("skip_seq") > F.coalesce(F.col("l.seq"), F.lit(-1)), F.lit(False))
    states = states.select(
        "group_ordinal",
        "group_id",
        "n",
        F.when(skipped, F.lit(KEEP_ALL)).otherwise(F.col("l.action")).alias("action"),
        F.when(~skipped, F.col("l.file_id")).alias("chosen"),
        F.coalesce(F.greatest("skip_seq", F.col("l.seq")), F.lit(-1)).alias("since"),
    )
    states = materialize(states, "states")
    toggles = actions.where(F.col("action") == TOGGLE).select("group_ordinal", F.col("file_id").alias("t"), "seq")
    flips = (
        toggles.join(states.select("group_ordinal", "since"), "group_ordinal")
        .where(F.col("seq") > F.col("since"))
        .groupBy("t")
        .agg(F.count("*").alias("flips"))
    )
    set_to = (
        F.when(F.col("action") == KEEP_ALL, F.lit(True))
        .when(F.col("action") == DELETE_ALL, F.lit(False))
        .when(F.col("action") == KEEP_ONLY, F.col("file_id") == F.col("chosen"))
        .otherwise(F.col("_best").isNotNull())
    )
    placed = keyed_join(members, states, "group_id", "n").join(best, "file_id", "left")
    placed = placed.join(flips, F.col("file_id") == F.col("t"), "left")
    odd = F.coalesce(F.col("flips"), F.lit(0)) % 2 == 1
    return placed.select("group_id", "file_id", "file_size", (set_to != odd).alias("keep"))


def delete_list(decisions: DataFrame) -> DataFrame:
    return decisions.where(~F.col("keep")).drop("keep")


def reclaimable(decisions: DataFrame) -> DataFrame:
    """Number and bytes of the files marked for deletion."""
    gone = delete_list(decisions)
    return gone.agg(F.count("*").alias("files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))


def folder_breakdown(members: DataFrame, target_dir: str) -> DataFrame:
    """(group_id, folder, files, folders, multi_folder) of shown groups."""
    per_folder = members.groupBy("group_id", relative_folder(F.col("path"), target_dir).alias("folder")).agg(
        F.count("*").alias("files")
    )
    per_group = per_folder.groupBy("group_id").agg(F.count("*").alias("folders"))
    return per_folder.join(per_group, "group_id").withColumn("multi_folder", F.col("folders") > 1)
