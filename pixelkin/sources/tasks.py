"""Tasks of even work over files: cut by prefix sums of bytes, files beyond a task's share alone.

Files are dealt into groups of some ten thousand; inside a group a running sum of costs (bytes, and a fixed cost for
opening a file) cuts the tasks. One number per group, how many tasks it has, goes through the driver; rows then go to their
task by its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelkin.session import materialize

#: Bytes that one task reads, and what opening a file counts for: at most 500 files a task.
TASK_BYTES = 256 << 20
OPEN_BYTES = TASK_BYTES // 500
#: Files that are summed up together.
GROUP_FILES = 10_000


def task_numbers(files: DataFrame, size: str = "file_size", key: str = "path") -> tuple[DataFrame, int]:
    """A stored table of files with ``_task``, and the number of tasks. A null size counts as none."""
    cost = F.coalesce(F.col(size).cast("long"), F.lit(0)) + F.lit(OPEN_BYTES)
    groups = max(1, -(-files.count() // GROUP_FILES))
    dealt = files.withColumns({"_group": F.pmod(F.xxhash64(key), F.lit(groups)), "_cost": cost, "_alone": cost >= TASK_BYTES})
    # Rows of one group are bounded, so are these windows.
    order = Window.partitionBy("_group", "_alone").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_cost").over(order), F.lit(0))
    nth = F.coalesce(F.count("*").over(order), F.lit(0))
    local = F.when(F.col("_alone"), nth).otherwise(F.floor(before / TASK_BYTES))
    local = materialize(dealt.withColumn("_local", local.cast("long")), "file-tasks")
    counts = local.groupBy("_group", "_alone").agg((F.max("_local") + 1).alias("n")).orderBy("_group", "_alone").collect()
    offsets, total = [], 0
    for r in counts:
        offsets.append((r["_group"], r["_alone"], total))
        total += r["n"]
    if not offsets:
        return files.withColumn("_task", F.lit(0)), 1
    starts = files.sparkSession.createDataFrame(offsets, "_group long, _alone boolean, _start long")
    # Two rows for every ten thousand files.
    numbered = local.join(starts, ["_group", "_alone"]).withColumn("_task", (F.col("_start") + F.col("_local")).cast("int"))
    return numbered.drop("_group", "_alone", "_cost", "_local", "_start"), total


def in_even_tasks(files: DataFrame, size: str = "file_size", key: str = "path") -> DataFrame:
    """``files`` with one partition for every task; without sizes, tasks are cut by the number of files."""
    columns = files.columns
    if size not in columns:
        files = files.withColumn(size, F.lit(0).cast("long"))
    numbered, total = task_numbers(files, size, key)
    return numbered.repartitionById(total, F.col("_task")).select(*columns)
