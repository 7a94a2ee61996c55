"""Positions in a global or per-group order without gathering rows in one task.

Rows are range-partitioned, numbered inside their partition and written once; a partition's offset comes
from the pre-aggregated counts, which are one row per partition (and group).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelkin.session import materialize

_WITHIN = (1 << 33) - 1


def _numbered(df: DataFrame, order: list) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return materialize(ranged.withColumn("_id", F.monotonically_increasing_id()), "ordered").withColumn(
        "_part", F.shiftright("_id", 33)
    )


def with_ordinal(df: DataFrame, order: list, name: str) -> DataFrame:
    """0-based position in the order given by columns or column names."""
    numbered = _numbered(df, order)
    # One row per partition, whatever the size of the data.
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = numbered.join(F.broadcast(offsets), "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_id").bitwiseAND(F.lit(_WITHIN))).drop(
        "_part", "_id", "_before"
    )


def with_group_ordinal(df: DataFrame, group: list[str], order: list, name: str) -> DataFrame:
    """0-based position inside each group; a group may span any number of partitions."""
    numbered = _numbered(df, [*group, *order])
    pieces = numbered.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    # A group has at most one row per partition here.
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    placed = numbered.join(pieces, [*group, "_part"])
    return placed.withColumn(name, F.col("_before") + F.col("_id") - F.col("_first")).drop(
        "_part", "_id", "_first", "_before"
    )
