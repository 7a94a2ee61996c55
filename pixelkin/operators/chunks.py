"""Chunks: the rows of a key packed into arrays of bounded length.

Comparing everything inside a group is expressed as a join of the group's chunks, so a group of any size
becomes many tasks of bounded size, and only matches leave a task, never candidate pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelkin.session import materialize


def chunked(df: DataFrame, key: list[str], spread_by: str, fields: list[str], size: int) -> DataFrame:
    """(key..., chunk, items): ``items`` holds about ``size`` structs of ``fields``.

    Counts are pre-aggregated; only keys above ``size`` rows are looked up again to be spread.
    """
    large = df.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > size)
    pieces = F.ceil(F.coalesce("_n", F.lit(1)) / F.lit(float(size)))
    spread = df.join(large, key, "left").withColumn(
        "chunk", F.pmod(F.xxhash64(spread_by), pieces.cast("long")).cast("long")
    )
    # The join above may deal rows out by key alone, which would serve the grouping but leave a hot key in one task.
    spread = spread.repartition(*key, "chunk")
    return spread.groupBy(*key, "chunk").agg(F.collect_list(F.struct(*fields)).alias("items"))


def busy_blocks(spark: SparkSession, rows: int) -> int:
    """Blocks per side that give every core a few pairs of blocks, without blocks below 256 rows."""
    return min(math.ceil(rows / 256), math.ceil(math.sqrt(8 * spark.sparkContext.defaultParallelism)))


def grid_chunks(df: DataFrame, spread_by: str, fields: list[str], pieces: int) -> DataFrame:
    """(chunk, items): the whole frame in ``pieces`` chunks."""
    return (
        df.withColumn("chunk", F.pmod(F.xxhash64(spread_by), F.lit(pieces)).cast("long"))
        .groupBy("chunk")
        .agg(F.collect_list(F.struct(*fields)).alias("items"))
    )


def grid_pairs(chunks: DataFrame, pieces: int) -> DataFrame:
    """Every unordered pair of chunks once (left, right, same), as an equi-join on the partner's number."""
    chunks = materialize(chunks, "blocks")
    left = chunks.select(
        F.col("chunk").alias("lc"),
        F.col("items").alias("left"),
        F.explode(F.sequence(F.col("chunk"), F.lit(pieces - 1).cast("long"))).alias("chunk"),
    )
    pairs = left.join(chunks, "chunk").select(
        "left", F.col("items").alias("right"), (F.col("lc") == F.col("chunk")).alias("same")
    )
    # Every pair of blocks is the same amount of work, so deal them out evenly.
    cores = chunks.sparkSession.sparkContext.defaultParallelism
    return pairs.repartition(min(pieces * (pieces + 1) // 2, max(4 * cores, pieces)))


def items_of(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, pa.StructArray]:
    """Offsets and flat struct values of a list column."""
    column = batch.column(batch.schema.get_field_index(name))
    offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
    return offsets, column.flatten()


def struct_field(values: pa.StructArray, name: str) -> pa.Array:
    return values.field(values.type.get_field_index(name)) if values.offset == 0 else values.flatten()[
        values.type.get_field_index(name)
    ]


def matrix_of(vectors: pa.Array) -> np.ndarray:
    """Equal-length list column as a matrix."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 0)


def batches_of(rows: list[dict], schema: pa.Schema):
    """Arrow batches of collected column arrays; nothing for no rows."""
    if rows:
        columns = [pa.concat_arrays([pa.array(r[f.name], f.type) for r in rows]) for f in schema]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


