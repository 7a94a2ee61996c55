"""A metric partition of points: blocks of near points that the triangle inequality keeps apart.

Pivots are points far from each other, picked from a bounded sample. Every point belongs to the cell of its nearest pivot;
inside a cell, points of one distance ring to it lie together, in blocks of bounded size. A block knows the range of
distances of its points to every pivot. Two points within a reach have, to each pivot, distances at most the reach apart,
so two blocks whose ranges are further apart at any pivot hold no pair, and are never joined.

Blocks of one cell are stored together in bands of bounded size. Bands meet as a Cartesian product of the stored table: a
task reads its two parts of it, so the contents are never shuffled by pairs. Bands that lie apart are passed over by
Spark, blocks that lie apart inside the task.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelkin.operators.chunks import chunked, items_of, matrix_of, struct_field
from pixelkin.session import materialize

#: Points that pivots are picked from, and the most pivots.
SAMPLE_POINTS = 8192
MOST_PIVOTS = 128
#: Rings of a cell.
RINGS = 16
#: Files of packed bands, unless there are more cores.
MOST_PARTS = 256


@dataclass(frozen=True)
class Metric:
    """How an Arrow column becomes points, and distances of points (rows) to pivots (columns).

    ``slack`` widens every comparison by what rounding may be off.
    """

    points: Callable[[pa.Array], np.ndarray]
    distances: Callable[[np.ndarray, np.ndarray], np.ndarray]
    widest: float
    slack: float


def _hash_points(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _hash_distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.bitwise_count((points[:, None] ^ pivots[None, :]).view(np.uint64)).astype(np.float64)


def _unit_points(column: pa.Array) -> np.ndarray:
    rows = matrix_of(column).astype(np.float64)
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(norms > 0, norms, 1.0)


def _angles(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(points @ pivots.T, -1.0, 1.0))


HAMMING = Metric(_hash_points, _hash_distances, 64.0, 0.0)
ANGLE = Metric(_unit_points, _angles, math.pi, 1e-6)


def far_pivots(points: np.ndarray, metric: Metric, count: int) -> np.ndarray:
    """Greedily the point farthest from all pivots so far, ``count`` times or until all points are pivots."""
    if not len(points):
        return points
    chosen = [0]
    nearest = metric.distances(points, points[:1])[:, 0]
    while len(chosen) < count and nearest.max() > metric.slack:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, metric.distances(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def _celled(metric: Metric, pivots: np.ndarray, value: str):
    """Adds (cell, ring) to rows; points are looked at a bounded number at a time."""

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(value))
            cells, rings = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for at in range(0, batch.num_rows, 4096):
                away = metric.distances(metric.points(column.slice(at, 4096)), pivots)
                cell = away.argmin(axis=1)
                cells[at : at + 4096] = cell
                rings[at : at + 4096] = away[np.arange(len(cell)), cell] * RINGS / metric.widest
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells), pa.array(rings)], [*batch.schema.names, "cell", "ring"])

    return run


def _ranged(metric: Metric, pivots: np.ndarray, value: str):
    """Adds (low, high) to blocks: least and greatest distance of their items to every pivot."""

    def run(batches):
        for batch in batches:
            offsets, items = items_of(batch, "items")
            column = struct_field(items, value)
            low, high = [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                away = metric.distances(metric.points(column.slice(a, b - a)), pivots)
                low.append(away.min(axis=0))
                high.append(away.max(axis=0))
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low, kind), pa.array(high, kind)], [*batch.schema.names, "low", "high"])

    return run


def _apart(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> np.ndarray:
    """The widest gap between the ranges at any pivot, for every pair of rows."""
    gap = np.maximum(other_low[None, :, :] - high[:, None, :], low[:, None, :] - other_high[None, :, :])
    return gap.max(axis=2)


def _kept_pairs(reach: float):
    """Rows (block, low, high, partner, partner_low, partner_high) whose ranges come within the reach."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            low, high, other_low, other_high = (
                matrix_of(batch.column(batch.schema.get_field_index(c))) for c in ("low", "high", "other_low", "other_high")
            )
            gap = np.maximum(other_low - high, low - other_high).max(axis=1)
            near = pa.array(gap <= reach)
            yield batch.select(["block", "partner"]).filter(near)

    return run


def _sides(batch: pa.RecordBatch, name: str):
    """Of a column of bands: offsets of the blocks, their ranges, offsets of the items, items."""
    of_band, blocks = items_of(batch, name)
    held = struct_field(blocks, "items")
    at = held.offsets.to_numpy()
    return of_band, matrix_of(struct_field(blocks, "low")), matrix_of(struct_field(blocks, "high")), at - at[0], held.flatten()


def _tile_kernel(limit: float, compare: Callable, whole_from: float):
    """Pairs of bands (left, right, same) -> what ``compare`` (left items, right items, same) finds in blocks within the limit.

    Where the share ``whole_from`` of a pair of bands is to be compared, it is compared as a whole; else each block with all that
    are near it.
    """

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lo, low, high, la, left = _sides(batch, "left")
            ro, other_low, other_high, ra, right = _sides(batch, "right")
            same = batch.column(batch.schema.get_field_index("same")).to_pylist()
            for r in range(batch.num_rows):
                i, j = slice(int(lo[r]), int(lo[r + 1])), slice(int(ro[r]), int(ro[r + 1]))
                kept = np.array([_apart(low[k : k + 1], high[k : k + 1], other_low[j], other_high[j])[0] for k in range(i.start, i.stop)]) <= limit
                if same[r]:
                    kept = np.triu(kept)
                # Products of sizes need 64 bits.
                many, others = (np.diff(x[y.start : y.stop + 1]).astype(np.int64) for x, y in ((la, i), (ra, j)))
                whole = many.sum() * others.sum() / (2 if same[r] else 1)
                if many @ kept @ others >= whole_from * whole:
                    a, b = int(la[i.start]), int(ra[j.start])
                    yield from compare(left.slice(a, int(many.sum())), right.slice(b, int(others.sum())), same[r])
                    continue
                for k in np.flatnonzero(kept.any(axis=1)).tolist():
                    own = left.slice(int(la[i.start + k]), int(many[k]))
                    if same[r] and kept[k, k]:
                        yield from compare(own, own, True)
                        kept[k, k] = False
                    near = [right.slice(int(ra[j.start + x]), int(others[x])) for x in np.flatnonzero(kept[k]).tolist()]
                    if near:
                        yield from compare(own, pa.concat_arrays(near), False)

    return run


@dataclass(frozen=True)
class Partition:
    """Stored ``blocks`` (block, cell, items, low, high), and their bands (band, blocks, low, high)."""

    blocks: DataFrame
    bands: DataFrame
    pivots: int
    limit: float

    def pairs(self) -> DataFrame:
        """The pairs of blocks (block, partner) that may hold a pair; block <= partner."""
        ranges = self.blocks.select("block", "cell", "low", "high")
        near = self.blocks.sparkSession.createDataFrame(_near_cells(ranges, self.pivots, self.limit), "cell long, other long")
        sides = ranges.toDF("partner", "other", "other_low", "other_high")
        met = ranges.join(F.broadcast(near), "cell").join(sides.hint("merge"), "other").where("block <= partner")
        kept = met.select("block", "low", "high", "partner", "other_low", "other_high")
        return kept.mapInArrow(_kept_pairs(self.limit), "block long, partner long")

    def counts(self) -> dict[str, int]:
        """How many pairs of blocks there are, and how many are left out without being compared block by block."""
        n, kept = self.blocks.count(), self.pairs().count()
        return {"blocks": n, "block_pairs": n * (n + 1) // 2, "skipped": n * (n + 1) // 2 - kept}

    def compared(self, compare: Callable, schema, whole_from: float = 0.5) -> DataFrame:
        """What ``compare`` (left items, right items, same) yields for the blocks that do not lie apart.

        ``whole_from`` is the share of a pair of bands from which ``compare`` is better given all of it.
        """
        left = self.bands.toDF("band", "left", "low", "high")
        right = self.bands.toDF("partner", "right", "other_low", "other_high")
        gap = [F.array_max(F.zip_with(a, b, lambda x, y: x - y)) for a, b in (("low", "other_high"), ("other_low", "high"))]
        near = (F.col("band") <= F.col("partner")) & (gap[0] <= self.limit) & (gap[1] <= self.limit)
        # Read in parts from storage, never shuffled: each task meets one part with another.
        met = left.join(right.hint("shuffle_replicate_nl"), near)
        met = met.select("left", "right", (F.col("band") == F.col("partner")).alias("same"))
        return met.mapInArrow(_tile_kernel(self.limit, compare, whole_from), schema)


def partitioned(
    points: DataFrame, value: str, spread_by: str, fields: list[str], metric: Metric, reach: float, rows: int, block_rows: int,
    band_rows: int, packed: bool = False,
) -> Partition:
    """The metric partition of stored ``points`` whose ``value`` column holds the points; ``rows`` is their number.

    Bands hold about ``band_rows`` points, of one cell, or if ``packed`` of as many cells as it takes.
    """
    spark = points.sparkSession
    share = max(1, rows // SAMPLE_POINTS)
    sample = points.where(F.pmod(F.xxhash64(spread_by, F.lit(17)), F.lit(share)) == 0).select(value).limit(2 * SAMPLE_POINTS)
    found = sample.toArrow()[value].combine_chunks()
    count = min(MOST_PIVOTS, max(2, math.isqrt(rows // max(1, block_rows)) * 4))
    # A sample may miss a small table; any point will do then.
    pivots = metric.points(found if len(found) else points.select(value).limit(1).toArrow()[value].combine_chunks())
    pivots = far_pivots(pivots, metric, count)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
    celled = points.mapInArrow(_celled(metric, pivots, value), f"{schema}, cell long, ring long")
    chunks = chunked(celled, ["cell", "ring"], spread_by, fields, block_rows)
    wide = F.lit(1 << 40)
    number = (F.col("cell") * RINGS * 2 + F.col("ring")) * wide + F.col("chunk")
    blocks = chunks.select(number.alias("block"), "cell", "items")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema)
    blocks = blocks.mapInArrow(_ranged(metric, pivots, value), f"{kind}, low array<double>, high array<double>")
    blocks = materialize(blocks, "metric-blocks")
    # One row per cell, at most one per pivot.
    sizes = blocks.groupBy("cell").agg(F.sum(F.size("items")).alias("n")).orderBy("cell").collect()
    first, total = _first_bands([(r["cell"], r["n"]) for r in sizes], band_rows, packed)
    first = spark.createDataFrame(first, "cell long, first long, pieces long")
    banded = blocks.join(F.broadcast(first), "cell").withColumn("band", F.col("first") + F.pmod(F.xxhash64("block"), F.col("pieces")))
    # So many files that a product of their parts keeps every core busy, whatever adaptive execution makes of small tables.
    parts = 4 * spark.sparkContext.defaultParallelism
    parts = max(1, min(max(parts, MOST_PARTS), total)) if packed else max(1, min(parts, max(count, -(-rows // band_rows))))
    if not packed:
        banded = banded.repartition(parts, "band")
    bands = banded.groupBy("band").agg(F.collect_list(F.struct("low", "high", "items")).alias("blocks"))
    if packed:
        bands = bands.repartitionById(parts, F.pmod(F.col("band"), F.lit(parts)).cast("int"))
    over = F.sequence(F.lit(0), F.lit(len(pivots) - 1))
    low = F.transform(over, lambda k: F.array_min(F.transform("blocks", lambda b: F.get(b["low"], k))))
    high = F.transform(over, lambda k: F.array_max(F.transform("blocks", lambda b: F.get(b["high"], k))))
    bands = materialize(bands.select("band", "blocks", low.alias("low"), high.alias("high")), "metric-bands")
    return Partition(blocks, bands, len(pivots), reach + 2 * metric.slack)


def _first_bands(sizes: list[tuple[int, int]], band_rows: int, packed: bool) -> tuple[list[tuple[int, int, int]], int]:
    """(cell, its first band, number of its bands) for cells and their sizes, and the number of bands."""
    first, bands, room = [], 0, 0
    for cell, n in sizes:
        pieces = -(-n // band_rows)
        if packed and n <= room:
            first.append((cell, bands - 1, 1))
            room -= n
            continue
        first.append((cell, bands, pieces))
        bands += pieces
        room = band_rows - n if pieces == 1 else 0
    return first, bands


def _near_cells(ranges: DataFrame, pivots: int, limit: float) -> list[tuple[int, int]]:
    """Pairs of cells whose ranges come within the limit; one row per cell, at most one per pivot, is collected."""
    over = [F.min(F.get("low", F.lit(k))).alias(f"l{k}") for k in range(pivots)]
    over += [F.max(F.get("high", F.lit(k))).alias(f"h{k}") for k in range(pivots)]
    rows = ranges.groupBy("cell").agg(*over).collect()
    if not rows:
        return [(0, 0)]
    low = np.array([[r[f"l{k}"] for k in range(pivots)] for r in rows])
    high = np.array([[r[f"h{k}"] for k in range(pivots)] for r in rows])
    i, j = np.nonzero(_apart(low, high, low, high) <= limit)
    return [(rows[a]["cell"], rows[b]["cell"]) for a, b in zip(i.tolist(), j.tolist())]
