"""Splitting of oversized groups by first fit at a stricter threshold.

Members with equal hash (or vector) always land in the same part, so only the distinct values of a group,
in order of first appearance, are placed. A group with more distinct values than one task should hold is
placed in batches: the fit of a batch to the existing parts is computed by joins, only the batch itself is
walked in order. What a batch has placed is added to a store and never written again, in chunks that later batches meet as
a product of stored parts, with one tally for each part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelkin.operators.chunks import batches_of, chunked, items_of, matrix_of, struct_field
from pixelkin.operators.ordinals import with_group_ordinal
from pixelkin.operators.vectors import DIGITS
from pixelkin.session import Added, is_empty, materialize


def _fit_matrix(metric: str, limit: float, left: pa.Array, right: pa.Array) -> np.ndarray:
    if metric == "hamming":
        lh, rh = left.to_numpy(), right.to_numpy()
        return np.bitwise_count((lh[:, None] ^ rh[None, :]).view(np.uint64)) <= limit
    width, other = np.diff(left.offsets.to_numpy()), np.diff(right.offsets.to_numpy())
    fits = np.zeros((len(left), len(right)), bool)
    for n in set(width.tolist()) & set(other.tolist()):
        li, ri = np.nonzero(width == n)[0], np.nonzero(other == n)[0]
        lm, rm = matrix_of(left.take(pa.array(li))), matrix_of(right.take(pa.array(ri)))
        fits[np.ix_(li, ri)] = np.round(lm.astype(np.float64) @ rm.astype(np.float64).T, DIGITS) >= limit
    return fits


#: Rows of the fit matrix worked out at once.
_FIT_ROWS = 256


def first_fit(count: int, allowed: list[list[int]], start: int, rows_of) -> list[int]:
    """Part number of each value in order.

    ``allowed[i]`` lists the earlier parts that accept value i; new parts are numbered from ``start``, above all
    earlier ones; ``rows_of(a, b)`` tells which of the values fit the values a to b. Each part keeps a mask of the
    values that fit all of its members.
    """
    names = sorted({p for parts in allowed for p in parts})
    at = {p: k for k, p in enumerate(names)}
    open_to = np.zeros((len(names) + 16, count), bool)
    for i, parts in enumerate(allowed):
        open_to[[at[p] for p in parts], i] = True
    part_of: list[int] = []
    for first in range(0, count, _FIT_ROWS):
        fits = rows_of(first, min(first + _FIT_ROWS, count))
        for i in range(first, first + len(fits)):
            k = int(open_to[: len(names), i].argmax()) if names else 0
            if not names or not open_to[k, i]:
                k = len(names)
                names.append(max(start, names[-1] + 1 if names else start))
                if k == len(open_to):
                    open_to = np.concatenate([open_to, np.zeros_like(open_to)])
                open_to[k] = True
            open_to[k] &= fits[i - first]
            part_of.append(names[k])
    return part_of


def _place_kernel(metric: str, limit: float, grp_type: pa.DataType):
    """(grp, start, items) -> (grp, id, part); items are in order and know the earlier parts they fit."""
    schema = pa.schema([("grp", grp_type), ("id", pa.string()), ("part", pa.int64())])

    def run(batches):
        for batch in batches:
            offsets, items = items_of(batch, "items")
            ids, values, allowed = (struct_field(items, f) for f in ("id", "value", "allowed"))
            groups = batch.column(batch.schema.get_field_index("grp"))
            starts = batch.column(batch.schema.get_field_index("start")).to_pylist()
            rows = []
            for r in range(batch.num_rows):
                at, size = int(offsets[r]), int(offsets[r + 1] - offsets[r])
                own = values.slice(at, size)
                parts = first_fit(
                    size,
                    [x or [] for x in allowed.slice(at, size).to_pylist()],
                    starts[r],
                    lambda a, b, own=own: _fit_matrix(metric, limit, own.slice(a, b - a), own),
                )
                rows.append(
                    {
                        "grp": groups.take(pa.array(np.full(size, r))),
                        "id": ids.slice(at, size),
                        "part": np.array(parts, np.int64),
                    }
                )
            yield from batches_of(rows, schema)

    return run


def _count_kernel(metric: str, limit: float, grp_type: pa.DataType):
    """Chunk of a batch against a chunk of placed values -> (grp, id, part, fitting)."""
    schema = pa.schema([("grp", grp_type), ("id", pa.string()), ("part", pa.int64()), ("fitting", pa.int64())])

    def run(batches):
        for batch in batches:
            lo, lv = items_of(batch, "left")
            ro, rv = items_of(batch, "right")
            ids, lval, rval = struct_field(lv, "id"), struct_field(lv, "value"), struct_field(rv, "value")
            part = struct_field(rv, "part").to_numpy()
            groups = batch.column(batch.schema.get_field_index("grp"))
            rows = []
            for r in range(batch.num_rows):
                at, size = int(lo[r]), int(lo[r + 1] - lo[r])
                to, more = int(ro[r]), int(ro[r + 1] - ro[r])
                fits = _fit_matrix(metric, limit, lval.slice(at, size), rval.slice(to, more))
                numbers, codes = np.unique(part[to : to + more], return_inverse=True)
                order = np.argsort(codes, kind="stable")
                counts = np.add.reduceat(fits[:, order], np.searchsorted(codes[order], np.arange(len(numbers))), axis=1, dtype=np.int64)
                i, c = np.nonzero(counts)
                rows.append(
                    {
                        "grp": groups.take(pa.array(np.full(len(i), r))),
                        "id": ids.take(pa.array(i + at)),
                        "part": numbers[c],
                        "fitting": counts[i, c],
                    }
                )
            yield from batches_of(rows, schema)

    return run


def _place(packed: DataFrame, metric: str, limit: float, grp_type: T.DataType) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    schema = T.StructType(
        [T.StructField("grp", grp_type), T.StructField("id", T.StringType()), T.StructField("part", T.LongType())]
    )
    return packed.select("grp", "start", "items").mapInArrow(_place_kernel(metric, limit, to_arrow_type(grp_type)), schema)


def _pack(points: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("pos", "id", "value", "allowed")))
    return points.groupBy("grp", "start").agg(
        F.transform(ordered, lambda e: F.struct(e["id"].alias("id"), e["value"].alias("value"), e["allowed"].alias("allowed"))).alias("items")
    )


def _place_in_batches(points: DataFrame, metric: str, limit: float, batch_rows: int, chunk_rows: int) -> DataFrame:
    """Groups of any size, one batch of ``batch_rows`` values per group and round."""
    from pyspark.sql.pandas.types import to_arrow_type

    grp_type = points.schema["grp"].dataType
    ordered = with_group_ordinal(points, ["grp"], ["pos", "id"], "at")
    ordered = materialize(ordered.withColumn("batch", F.floor(F.col("at") / batch_rows)), "split-batches")
    rounds = ordered.agg(F.max("batch")).first()[0] + 1
    store = Added("split-placed", points.sparkSession)
    chunks = Added("split-chunks", points.sparkSession)
    tallies = Added("split-tallies", points.sparkSession)
    placed = packed = tallied = None
    for number in range(rounds):
        fresh = ordered.where(F.col("batch") == number).select("grp", "pos", "id", "value")
        if placed is None:
            ready = fresh.withColumn("start", F.lit(0).cast("long")).withColumn("allowed", F.lit(None).cast("array<bigint>"))
        else:
            left = chunked(fresh, ["grp"], "id", ["id", "value"], chunk_rows).select("grp", F.col("items").alias("left"))
            left = materialize(left, "split-fresh")
            right = packed.select(F.col("grp").alias("_grp"), F.col("items").alias("right"))
            schema = T.StructType(
                [
                    T.StructField("grp", grp_type),
                    T.StructField("id", T.StringType()),
                    T.StructField("part", T.LongType()),
                    T.StructField("fitting", T.LongType()),
                ]
            )
            # What is placed is read in parts from storage and never shuffled again.
            met = right.join(left.hint("shuffle_replicate_nl"), F.col("_grp") == F.col("grp")).select("grp", "left", "right")
            counted = met.mapInArrow(_count_kernel(metric, limit, to_arrow_type(grp_type)), schema)
            sizes = tallied.groupBy("grp", "part").agg(F.sum("size").alias("size"))
            fitting = counted.groupBy("grp", "id", "part").agg(F.sum("fitting").alias("fitting")).join(sizes, ["grp", "part"])
            allowed = (
                fitting.where(F.col("fitting") == F.col("size"))
                .groupBy("grp", "id")
                .agg(F.sort_array(F.collect_list("part")).alias("allowed"))
            )
            starts = sizes.groupBy("grp").agg((F.max("part") + 1).alias("start"))
            ready = fresh.join(starts, "grp").join(allowed, ["grp", "id"], "left")
        parts = _place(_pack(ready), metric, limit, grp_type)
        parts = fresh.join(parts, ["grp", "id"]).select("grp", "id", "value", "part")
        placed, own = store.add(parts)
        if number + 1 < rounds:
            packed, _ = chunks.add(chunked(own, ["grp"], "id", ["value", "part"], chunk_rows).select("grp", "items"))
        tallied, _ = tallies.add(own.groupBy("grp", "part").agg(F.count("*").alias("size")))
    return placed.select("grp", "id", "part")


def split_by_first_fit(
    points: DataFrame, metric: str, limit: float, point_limit: int = 8_000, chunk_rows: int = 512
) -> DataFrame:
    """(grp, id, part) for ``points`` (grp, pos, id, value); ``pos`` orders the values of a group.

    ``metric`` is ``hamming`` (distance at most ``limit``) or ``cosine`` (similarity at least ``limit``).
    """
    points = materialize(points.select("grp", "pos", "id", "value"), "split-points")
    large = points.groupBy("grp").count().where(F.col("count") > point_limit).select("grp")
    large = materialize(large, "split-large")
    ready = points.withColumn("start", F.lit(0).cast("long")).withColumn("allowed", F.lit(None).cast("array<bigint>"))
    if is_empty(large):
        return _place(_pack(ready), metric, limit, points.schema["grp"].dataType)
    small = _place(_pack(ready.join(large, "grp", "left_anti")), metric, limit, points.schema["grp"].dataType)
    rest = points.join(large, "grp", "left_semi")
    return small.unionByName(_place_in_batches(rest, metric, limit, point_limit, chunk_rows))
