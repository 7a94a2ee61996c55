"""Table schemas of the catalog and conforming of foreign frames to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROJECTS = T.StructType(
    [
        T.StructField("project_id", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("target_dir", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

ROOTS = T.StructType(
    [
        T.StructField("root_id", T.StringType(), False),
        T.StructField("project_id", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("created_at", T.TimestampType()),
    ]
)

FILES = T.StructType(
    [
        T.StructField("file_id", T.StringType(), False),
        T.StructField("project_id", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("file_name", T.StringType(), False),
        T.StructField("file_size", T.LongType(), False),
        T.StructField("file_type", T.StringType(), False),
        T.StructField("taken_at", T.StringType()),
        T.StructField("phash", T.LongType()),
        T.StructField("md5", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

# The log of an ingest: what was listed below its folder.
LISTED = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("file_size", T.LongType()),
        T.StructField("modified_at", T.TimestampType()),
    ]
)

VECTORS = T.StructType(
    [
        T.StructField("file_id", T.StringType(), False),
        T.StructField("vector", T.ArrayType(T.FloatType())),
    ]
)

GROUPS = T.StructType(
    [
        T.StructField("project_id", T.StringType(), False),
        T.StructField("file_id", T.StringType(), False),
        T.StructField("group_id", T.StringType(), False),
    ]
)

# A review action; ``file_id`` is set for the actions that point at one file.
ACTIONS = T.StructType(
    [
        T.StructField("group_ordinal", T.LongType(), False),
        T.StructField("file_id", T.StringType()),
        T.StructField("action", T.StringType(), False),
        T.StructField("seq", T.LongType(), False),
    ]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in order, cast; a missing column becomes a typed null."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
