"""Comparisons of feature vectors in bounded chunks.

Similarities are rounded to nine digits, so that neither the threshold nor the order of pairs depends on
how rows happened to be blocked.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelkin.functions.fingerprints import cosine, dot, hamming
from pixelkin.operators.chunks import batches_of, busy_blocks, chunked, grid_chunks, grid_pairs, items_of, matrix_of, struct_field
from pixelkin.operators.pivots import ANGLE, Partition, partitioned
from pixelkin.operators.skew import keyed_join
from pixelkin.session import is_empty, materialize

DIGITS = 9
# Size of a block, whatever the number of vectors; more vectors make more blocks and tasks.
_BLOCK_BYTES = 4 << 20
# Vectors of this length are multiplied in two steps.
_LONG_VECTOR = 64
# Rows and columns of a product worked out at once.
_TILE = (256, 2048)
# Rows with no more pairs of items than this are worked out as one flat product; values of it that are held at once.
_FLAT_PAIRS = 1024
_FLAT_VALUES = 1 << 20
# Above so many vectors of one length, blocks are those of a metric partition by angles.
PIVOT_ROWS = 50_000


def vector_key(vector) -> F.Column:
    """Digest that names a vector's exact content; null for a missing or empty one."""
    return F.when(F.size(vector) > 0, F.sha2(F.to_json(F.struct(vector)), 256))


def _by_length(vectors: pa.Array) -> dict[int, np.ndarray]:
    lengths = np.diff(vectors.offsets.to_numpy())
    return {int(n): np.nonzero(lengths == n)[0] for n in np.unique(lengths) if n}


def _matrices(left: pa.Array, right: pa.Array):
    """(left positions, right positions, left matrix, right matrix) for each shared vector length."""
    lk, rk = _by_length(left), _by_length(right)
    for n in lk.keys() & rk.keys():
        li, ri = lk[n], rk[n]
        lm = matrix_of(left if len(li) == len(left) else left.take(pa.array(li))).astype(np.float64)
        rm = matrix_of(right if len(ri) == len(right) else right.take(pa.array(ri))).astype(np.float64)
        yield li, ri, lm, rm


def _similarities(left: pa.Array, right: pa.Array):
    """(left positions, right positions, unrounded similarity matrix) for each shared vector length."""
    for li, ri, lm, rm in _matrices(left, right):
        yield li, ri, lm @ rm.T


def _flat(lo: np.ndarray, ro: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of the items of two list columns in ``rows``, row by row.

    Returns (left item, right item) of every pair, the left items concerned, and where the pairs of each begin.
    """
    many = np.diff(lo)[rows]
    row = np.repeat(rows, many)
    left = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + lo[row]
    width = np.diff(ro)[row]
    first = np.cumsum(width) - width
    right = np.arange(width.sum()) - np.repeat(first, width) + np.repeat(ro[row], width)
    return np.repeat(left, width), right, left, first


def _pair_dots(left: pa.Array, right: pa.Array, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Dot product of every pair of items; 0 for vectors of unequal length. One flat product for each length."""
    out = np.zeros(len(i))
    widths, others = np.diff(left.offsets.to_numpy()), np.diff(right.offsets.to_numpy())
    for width in np.unique(widths[i]).tolist():
        at = np.flatnonzero((widths[i] == width) & (others[j] == width))
        if not width or not len(at):
            continue
        sides = []
        for column, lengths, items in ((left, widths, i), (right, others, j)):
            mine = lengths == width
            rows = matrix_of(column if mine.all() else column.filter(pa.array(mine)))
            sides.append((rows, (np.cumsum(mine) - 1)[items[at]]))
        (lm, x), (rm, y) = sides
        step = max(1, _FLAT_VALUES // width)
        for k in range(0, len(at), step):
            part = slice(k, k + step)
            out[at[part]] = np.einsum("ij,ij->i", lm[x[part]].astype(np.float64), rm[y[part]].astype(np.float64))
    return out


def _small(lo: np.ndarray, ro: np.ndarray) -> np.ndarray:
    """Which rows have so few pairs that they are worked out together with others."""
    return np.diff(lo) * np.diff(ro) <= _FLAT_PAIRS


def _close(left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, similarity) of the pairs of rows that reach the threshold, unrounded.

    Of long vectors a half is multiplied first, in single precision: the rest can add no more than the product of its
    lengths. Where few pairs remain, only these are worked out in full. Products are made in pieces that stay in a cache.
    """
    width = left.shape[1]
    head = width // 2 if width >= _LONG_VECTOR else 0
    if head and len(left) and len(right):
        lengths = [float(np.sqrt((x * x).sum(axis=1).max())) for x in (left, right)]
        # More than rounding can take away from a product in single precision.
        limit = np.float32(threshold - (width + 16) * 3e-7 * lengths[0] * lengths[1])
        shorter = [_headed(x, head) for x in (left, right)]
    out = []
    for x in range(0, len(right), _TILE[1]):
        columns = right[x : x + _TILE[1]].T
        heads = np.ascontiguousarray(shorter[1][x : x + _TILE[1]].T) if head else None
        for y in range(0, len(left), _TILE[0]):
            rows = left[y : y + _TILE[0]]
            if head:
                may = shorter[0][y : y + _TILE[0]] @ heads >= limit
                if not may.any():
                    continue
                i, j = np.divmod(np.flatnonzero(may), may.shape[1])
            if head and len(i) * 16 <= may.size:
                sims = np.concatenate(
                    [np.einsum("ij,ij->i", rows[i[k : k + 8192]], right[x + j[k : k + 8192]]) for k in range(0, len(i), 8192)]
                )
                near = sims >= threshold
                i, j, sims = i[near], j[near], sims[near]
            else:
                sims = rows @ columns
                i, j = np.nonzero(sims >= threshold)
                sims = sims[i, j]
            if len(i):
                out.append((i + y, j + x, sims))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out))


def _headed(rows: np.ndarray, head: int) -> np.ndarray:
    """The first ``head`` numbers of every row and the length of the rest, in single precision."""
    out = np.empty((len(rows), head + 1), np.float32)
    out[:, :head] = rows[:, :head]
    out[:, head] = np.sqrt((rows[:, head:] ** 2).sum(axis=1))
    return out


def _found(left: pa.StructArray, right: pa.StructArray, same: bool, threshold: float):
    """Columns (a, b, sim) of the pairs of two blocks of items (id, vector) at or above the threshold."""
    lid, lvec, rid, rvec = (struct_field(v, f) for v in (left, right) for f in ("id", "vector"))
    for li, ri, lm, rm in _matrices(lvec, rvec):
        i, j, close = _close(lm, rm, threshold - 10.0**-DIGITS)
        close = np.round(close, DIGITS)
        kept = close >= threshold
        if same:
            kept &= li[i] < ri[j]
        i, j, close = i[kept], j[kept], close[kept]
        if len(i):
            yield {"a": lid.take(pa.array(li[i])), "b": rid.take(pa.array(ri[j])), "sim": close}


def _compared(threshold: float):
    """Pairs of the items of two blocks, as batches."""

    def run(left: pa.StructArray, right: pa.StructArray, same: bool):
        kind = struct_field(left, "id").type
        for found in _found(left, right, same, threshold):
            yield from batches_of([found], pa.schema([("a", kind), ("b", kind), ("sim", pa.float64())]))

    return run


def _pair_kernel(threshold: float):
    """Chunk pairs -> (a, b, sim) at or above the threshold; ``same`` marks a chunk against itself."""

    def run(batches):
        for batch in batches:
            lo, lv = items_of(batch, "left")
            ro, rv = items_of(batch, "right")
            lid, lvec, rid, rvec = (struct_field(v, f) for v in (lv, rv) for f in ("id", "vector"))
            same = batch.column(batch.schema.get_field_index("same")).to_pylist()
            schema = pa.schema([("a", lid.type), ("b", rid.type), ("sim", pa.float64())])
            rows = []
            small = _small(lo, ro)
            if small.any():
                own = np.flatnonzero(small)
                i, j, _, _ = _flat(lo, ro, own)
                # A chunk against itself has each pair once, by the places of its items.
                row_of = np.repeat(own, (np.diff(lo) * np.diff(ro))[own])
                once = ~np.array(same, bool)[row_of] | (i - lo[row_of] < j - ro[row_of])
                i, j = i[once], j[once]
                equal = np.diff(lvec.offsets.to_numpy())[i] == np.diff(rvec.offsets.to_numpy())[j]
                close = np.round(_pair_dots(lvec, rvec, i, j), DIGITS)
                kept = equal & (close >= threshold)
                if kept.any():
                    rows.append({"a": lid.take(pa.array(i[kept])), "b": rid.take(pa.array(j[kept])), "sim": close[kept]})
            for r in np.flatnonzero(~small).tolist():
                left, right = lv.slice(int(lo[r]), int(lo[r + 1] - lo[r])), rv.slice(int(ro[r]), int(ro[r + 1] - ro[r]))
                rows += _found(left, right, same[r], threshold)
            yield from batches_of(rows, schema)

    return run


def _pair_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [T.StructField("a", id_type), T.StructField("b", id_type), T.StructField("sim", T.DoubleType())]
    )


def angle_partition(points: DataFrame, threshold: float, rows: int, longest: float, block_rows: int) -> Partition:
    """Blocks of stored ``points`` (id, vector) of one width with near directions, and the pairs of blocks to compare.

    Two vectors no longer than ``longest`` reach the threshold only within a certain angle.
    """
    reach = math.acos(min(1.0, max(-1.0, (threshold - 10.0**-DIGITS) / max(longest**2, 1e-300))))
    width = points.select(F.max(F.size("vector"))).first()[0] or 1
    band_rows = max(256, _BLOCK_BYTES // (8 * width))
    return partitioned(points, "vector", "id", ["id", "vector"], ANGLE, reach, rows, block_rows, band_rows)


def pivot_cosine_pairs(points: DataFrame, threshold: float, rows: int, longest: float, block_rows: int) -> DataFrame:
    """Pairs of one width by comparing only those blocks that the triangle inequality of angles does not keep apart."""
    found = angle_partition(points, threshold, rows, longest, block_rows)
    found = found.compared(_compared(threshold), _pair_schema(points.schema["id"].dataType))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim")


def cosine_pairs(points: DataFrame, threshold: float, blocks: int | None = None) -> DataFrame:
    """All pairs of ``points`` (id, vector) with cosine at least ``threshold`` -> (a, b, sim), a < b.

    Exact: blocks of vectors against blocks of vectors as matrix products, spread evenly over the cluster. Many vectors
    of one width are cut into blocks of near directions first, and only blocks that may hold a pair meet.
    Equal vectors should be collapsed before.
    """
    points = points.where(F.size("vector") > 0)
    parts = []
    if blocks is None:
        # One row per width with so many vectors.
        norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))
        widths = points.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n"), F.max(norm).alias("longest"))
        sizes = widths.groupBy((F.col("n") > PIVOT_ROWS).alias("many")).agg(
            F.sum("n").alias("n"), F.max("width").alias("width"),
            F.collect_list(F.when(F.col("n") > PIVOT_ROWS, F.struct("width", "n", "longest"))).alias("found"),
        )
        n, width = 0, 1
        for row in sizes.collect():
            if row["many"] and threshold > 0:
                parts = row["found"]
            else:
                n, width = n + row["n"], max(width, row["width"])
        blocks = max(1, math.ceil(n * width * 8 / _BLOCK_BYTES), busy_blocks(points.sparkSession, n))
    out = None
    for part in parts:
        own = materialize(points.where(F.size("vector") == part["width"]), "wide-vectors")
        rows = max(256, min(4096, _BLOCK_BYTES // (8 * part["width"])))
        found = pivot_cosine_pairs(own, threshold, part["n"], part["longest"], rows)
        out = found if out is None else out.unionByName(found)
    if parts:
        points = points.where(~F.size("vector").isin([p["width"] for p in parts]))
    chunks = grid_chunks(points, "id", ["id", "vector"], blocks)
    found = grid_pairs(chunks, blocks).mapInArrow(_pair_kernel(threshold), _pair_schema(points.schema["id"].dataType))
    found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim")
    return found if out is None else out.unionByName(found)


def linked_cosine_pairs(links: DataFrame, points: DataFrame, threshold: float, chunk_rows: int) -> DataFrame:
    """Pairs of points whose keys are linked -> (a, b, sim, dist) with cosine at least ``threshold``.

    ``links``: (x, y, dist) over keys, x = y for pairs under one key; ``points``: (key, id, vector).
    A key with many points is compared chunk by chunk.
    """
    chunks = materialize(chunked(points.where(F.size("vector") > 0), ["key"], "id", ["id", "vector"], chunk_rows), "chunks")
    left = chunks.select(F.col("key").alias("x"), F.col("chunk").alias("lc"), F.col("items").alias("left"))
    right = chunks.select(F.col("key").alias("y"), F.col("chunk").alias("rc"), F.col("items").alias("right"))
    blocks = (
        links.join(left, "x")
        .join(right, "y")
        .where((F.col("x") != F.col("y")) | (F.col("lc") <= F.col("rc")))
        .select(
            "left", "right", ((F.col("x") == F.col("y")) & (F.col("lc") == F.col("rc"))).alias("same")
        )
    )
    return blocks.mapInArrow(_pair_kernel(threshold), _pair_schema(points.schema["id"].dataType))


def _worst_kernel(metric: str):
    """Chunk pairs of one group -> (id, worst) for the items on the left.

    ``worst`` is the largest distance, or the lowest similarity with its sign turned, to another file of the
    group; an item that stands for several files also meets itself.
    """

    def values(left, right):
        if metric == "cosine":
            sims = np.zeros((len(left), len(right)))
            for li, ri, part in _similarities(left, right):
                sims[np.ix_(li, ri)] = np.round(part, DIGITS)
            return -sims
        lh, rh = left.to_numpy(), right.to_numpy()
        return np.bitwise_count((lh[:, None] ^ rh[None, :]).view(np.uint64)).astype(np.float64)

    def run(batches):
        for batch in batches:
            lo, lv = items_of(batch, "left")
            ro, rv = items_of(batch, "right")
            ids, lval, files = struct_field(lv, "id"), struct_field(lv, "value"), struct_field(lv, "w").to_numpy()
            other, rval = struct_field(rv, "id"), struct_field(rv, "value")
            rows = []
            small = _small(lo, ro)
            if small.any():
                i, j, left, first = _flat(lo, ro, np.flatnonzero(small))
                if metric == "cosine":
                    value = -np.round(_pair_dots(lval, rval, i, j), DIGITS)
                else:
                    value = np.bitwise_count((lval.to_numpy()[i] ^ rval.to_numpy()[j]).view(np.uint64)).astype(np.float64)
                names = pa.concat_arrays([ids, other]).dictionary_encode().indices.to_numpy()
                value[(names[: len(ids)][i] == names[len(ids) :][j]) & (files[i] == 1)] = -np.inf
                rows.append({"id": ids.take(pa.array(left)), "worst": np.maximum.reduceat(value, first)})
            for r in np.flatnonzero(~small).tolist():
                at, size = int(lo[r]), int(lo[r + 1] - lo[r])
                to, more = int(ro[r]), int(ro[r + 1] - ro[r])
                own = ids.slice(at, size)
                worst = values(lval.slice(at, size), rval.slice(to, more))
                twin = pc.index_in(own, value_set=other.slice(to, more)).to_numpy(zero_copy_only=False)
                met = np.nonzero(~np.isnan(twin) & (files[at : at + size] == 1))[0]
                worst[met, twin[met].astype(int)] = -np.inf
                rows.append({"id": own, "worst": worst.max(axis=1)})
            yield from batches_of(rows, pa.schema([("id", ids.type), ("worst", pa.float64())]))

    return run


def _distance(metric: str, a, b) -> F.Column:
    if metric == "hamming":
        return hamming(a, b).cast("double")
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.round(cosine(a, b), DIGITS))))


def _screen(points: DataFrame, metric: str, limit: float, chunk_rows: int) -> tuple[DataFrame | None, DataFrame]:
    """(ids that are certainly too far, points to examine).

    Only groups above ``chunk_rows`` are screened, against one member each: a point too far from it has its
    witness; a point so close that even the farthest member of the group is within the limit (triangle
    inequality) is settled too. The rest is compared with the whole group.
    """
    sizes = points.groupBy("grp").agg(
        F.count("*").alias("n"), F.min_by("value", "id").alias("pivot"), F.min("id").alias("pivot_id")
    )
    large = materialize(sizes.where(F.col("n") > chunk_rows), "large-groups")
    if is_empty(large):
        return None, points
    off_length = F.lit(0.0)
    if metric == "cosine":
        off_length = F.abs(dot(F.col("value"), F.col("value")) - 1)
    measured = keyed_join(points, large, "grp", "n").withColumn("d", _distance(metric, F.col("value"), F.col("pivot")))
    measured = materialize(measured.withColumn("off", off_length).drop("pivot"), "measured")
    spans = measured.groupBy("grp").agg(F.max("d").alias("span"), F.max("off").alias("off"), F.max("n").alias("n"))
    measured = keyed_join(measured.drop("n", "off"), materialize(spans, "spans"), "grp", "n")
    # A hair of slack keeps every close call for the exact comparison; angles need vectors of length one.
    slack, reach = (0.0, limit) if metric == "hamming" else (1e-4, math.acos(limit))
    far = F.when(F.col("id") == F.col("pivot_id"), F.col("span")).otherwise(F.col("d")) > reach + slack
    close = (F.col("d") + F.col("span") <= reach - slack) & (F.col("off") < 1e-6)
    measured = measured.withColumn("far", far).withColumn("close", close)
    small = points.join(large.select("grp"), "grp", "left_anti")
    unsure = measured.where(~F.col("far") & ~F.col("close")).select("grp", "id", "value", "w")
    return measured.where("far").select("id"), small.unionByName(unsure)


def _too_far(points: DataFrame, metric: str, limit: float, chunk_rows: int) -> DataFrame:
    """(id) of ``points`` (grp, id, value, w) with a peer beyond ``limit``."""
    far, unsure = _screen(points, metric, limit, chunk_rows)
    schema = T.StructType([T.StructField("id", points.schema["id"].dataType), T.StructField("worst", T.DoubleType())])
    fields = ["id", "value", "w"]
    right = materialize(chunked(points, ["grp"], "id", fields, chunk_rows), "chunks")
    left = right if far is None else chunked(unsure, ["grp"], "id", fields, chunk_rows)
    blocks = left.select("grp", F.col("items").alias("left")).join(right.select("grp", F.col("items").alias("right")), "grp")
    worst = blocks.select("left", "right").mapInArrow(_worst_kernel(metric), schema).groupBy("id").agg(F.max("worst").alias("worst"))
    beyond = F.col("worst") > (limit if metric == "hamming" else -limit)
    found = worst.where(beyond).select("id")
    return found if far is None else found.unionByName(far)


def vector_evictions(points: DataFrame, threshold: float, chunk_rows: int) -> DataFrame:
    """(id) of the points to evict from their group.

    ``points``: (grp, id, vector, w), groups of at least two files. A file goes when it has no vector, or
    when its lowest cosine to the others that have one is below ``threshold``; all are judged against the
    group as it was.
    """
    blind = points.where(F.coalesce(F.size("vector"), F.lit(0)) <= 0).select("id")
    seeing = points.where(F.size("vector") > 0).select("grp", "id", F.col("vector").alias("value"), "w")
    return blind.unionByName(_too_far(seeing, "cosine", threshold, chunk_rows))


def hash_evictions(points: DataFrame, limit: int, chunk_rows: int) -> DataFrame:
    """(id) of the points farther than ``limit`` from a member of their group; ``points``: (grp, id, phash, w)."""
    return _too_far(points.select("grp", "id", F.col("phash").alias("value"), "w"), "hamming", limit, chunk_rows)


def self_similar(vector, threshold: float) -> F.Column:
    """False for the vectors of (almost) no length, which resemble nothing, not even themselves."""
    return F.round(dot(vector, vector), DIGITS) >= threshold
