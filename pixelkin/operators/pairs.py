"""Hamming range self-join over distinct 64-bit hashes.

Two hashes within distance T agree, up to a few bits, in at least one of m bands (pigeonhole). Both
sides list the band values within reach and meet in an equi-join; the join condition verifies the
distance and keeps each pair at exactly one meeting point, so no distinct is needed afterwards.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelkin.functions.fingerprints import hamming
from pixelkin.operators.chunks import batches_of, busy_blocks, chunked, grid_chunks, grid_pairs, items_of, struct_field
from pixelkin.operators.pivots import HAMMING, Partition, partitioned
from pixelkin.session import is_empty, materialize

PAIRS_SCHEMA = "a long, b long, dist int"
_PAIRS_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("dist", pa.int32())])

# Rough seconds per shuffled key, per candidate verified in the join, per pair compared in a block.
_KEY_COST, _CANDIDATE_COST, _BLOCK_COST = 1e-6, 5e-8, 1.5e-9
# Hashes in a block, whatever their number; more hashes make more blocks and tasks.
_BLOCK_ROWS = 4096
# Rows and columns of distances worked out at once: they stay in the nearest cache.
_TILE = (8, 4096)
# Inside a task: rough seconds to compare a pair and to gather what is near one band value, the most band values times reach of a
# layout, and how many found pairs are sent on at once.
_PAIR_COST, _VALUE_COST, _TILE_KEYS, _FOUND_ROWS = 7e-10, 5e-5, 1 << 21, 1 << 16
# Most hashes of a metric partition that are stored together; the more meet in a task, the fewer of their pairs it compares.
_BAND_ROWS = 1 << 18
# Above so many hashes, blocks are those of a metric partition, and pairs of blocks that lie apart are never joined.
PIVOT_ROWS = 50_000
# Band values shared by more hashes than this are compared in blocks instead of inside one join task.
HOT_BAND_ROWS = 50_000
_MASK64 = (1 << 64) - 1


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


@dataclass(frozen=True)
class Band:
    """Every m-th bit; matched up to ``left + right`` differing bits."""

    bits: tuple[int, ...]
    left: int
    right: int

    @property
    def radius(self) -> int:
        return self.left + self.right

    @property
    def mask(self) -> int:
        return _signed(sum(1 << i for i in self.bits))

    def flips(self, radius: int) -> list[int]:
        """All changes of up to ``radius`` bits inside the band."""
        return [
            _signed(sum(1 << i for i in chosen))
            for k in range(radius + 1)
            for chosen in combinations(self.bits, k)
        ]

    def reach(self, radius: int) -> int:
        return sum(math.comb(len(self.bits), k) for k in range(radius + 1))


def bands_for(threshold: int, m: int) -> list[Band]:
    """m interleaved bands whose radii add up so that one of them must match."""
    spare = threshold + 1 - m
    radii = [spare // m + (1 if i < spare % m else 0) for i in range(m)]
    return [
        Band(tuple(range(i, 64, m)), left=radii[i] - radii[i] // 2, right=radii[i] // 2)
        for i in range(m)
    ]


def choose_bands(threshold: int, n: int) -> list[Band] | None:
    """Cheapest band layout for ``n`` hashes, or None when comparing blocks is cheaper."""
    best, best_cost = None, n * n / 2 * _BLOCK_COST
    for m in range(2, min(threshold + 1, 12) + 1):
        bands = bands_for(threshold, m)
        if max(b.left for b in bands) > 3:
            continue
        keys = sum(b.reach(b.left) + b.reach(b.right) for b in bands)
        share = sum(b.reach(b.left) * b.reach(b.right) / 2.0 ** len(b.bits) for b in bands)
        cost = n * keys * _KEY_COST + n * n * share * _CANDIDATE_COST
        if cost < best_cost:
            best, best_cost = bands, cost
    return best


def _longs(values: list[int]) -> Column:
    """A constant array; one foldable text instead of one expression per element."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _probe(hashes: DataFrame, bands: list[Band], side: str, out: str) -> DataFrame:
    """One row per band value in reach: (out, band, key)."""
    points = [
        {"band": i, "mask": b.mask, "flip": f} for i, b in enumerate(bands) for f in b.flips(getattr(b, side))
    ]
    constant = F.from_json(F.lit(json.dumps(points)), "array<struct<band:tinyint,mask:bigint,flip:bigint>>")
    keyed = hashes.select(F.col("phash").alias(out), F.explode(constant).alias("p"))
    return keyed.select(
        out, "p.band", F.col(out).bitwiseAND(F.col("p.mask")).bitwiseXOR(F.col("p.flip")).alias("key")
    )


def _by_band(band: Column, values: list[Column]) -> Column:
    chosen = F.when(band == 0, values[0])
    for i, value in enumerate(values[1:], start=1):
        chosen = chosen.when(band == i, value)
    return chosen


def _lowest_bits(x: Column, count: int) -> Column:
    """The ``count`` lowest set bits of ``x``."""
    kept, rest = F.lit(0).cast("long"), x
    for _ in range(count):
        # The smallest long has no negative; it is its own lowest bit.
        low = F.when(rest == F.lit(_signed(1 << 63)), rest).otherwise(rest.bitwiseAND(F.negative(rest)))
        kept, rest = kept.bitwiseOR(low), rest.bitwiseXOR(low)
    return kept


def _meets_once(bands: list[Band], band: Column, key: Column, a: Column, b: Column) -> Column:
    """True at one meeting point per pair: the first matching band, and there one of the shared values."""
    diff = a.bitwiseXOR(b)
    first = F.lit(None).cast("int")
    for i, layout in reversed(list(enumerate(bands))):
        inside = F.bit_count(diff.bitwiseAND(F.lit(layout.mask))) <= layout.radius
        first = F.when(inside, F.lit(i)).otherwise(first)
    meeting = _by_band(
        band,
        [
            b.bitwiseAND(F.lit(x.mask)).bitwiseXOR(
                _lowest_bits(diff.bitwiseAND(F.lit(x.mask)), x.right)
            )
            for x in bands
        ],
    )
    return (band == first) & (key == meeting)


def _dense(left: np.ndarray, right: np.ndarray, threshold: int):
    """(a, b, dist) of the pairs within ``threshold``, comparing every pair."""
    for at in range(0, len(right), _TILE[1]):
        columns = right[at : at + _TILE[1]]
        high = min(len(left), _TILE[0] * _TILE[1] // len(columns))
        diff, dist = np.empty((high, len(columns)), np.uint64), np.empty((high, len(columns)), np.uint8)
        for start in range(0, len(left), high):
            rows = left[start : start + high]
            x, d = diff[: len(rows)], dist[: len(rows)]
            np.bitwise_xor(rows[:, None], columns[None, :], out=x)
            np.bitwise_count(x, out=d)
            if d.min() <= threshold:
                i, j = np.divmod(np.flatnonzero(d <= threshold), len(columns))
                yield rows[i], columns[j], d[i, j]


def _ball(width: int, radius: int) -> np.ndarray:
    """All numbers of ``width`` bits with up to ``radius`` of them set."""
    return np.array([sum(1 << i for i in chosen) for k in range(radius + 1) for chosen in combinations(range(width), k)])


def _values(hashes: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    """The bits of a band, packed into a small number."""
    value = np.zeros(len(hashes), np.int64)
    for i, bit in enumerate(bits):
        value |= (((hashes >> np.uint64(bit)) & np.uint64(1)) << np.uint64(i)).view(np.int64)
    return value


def _tile_layouts(threshold: int) -> list[list[Band]]:
    """Layouts whose band values can be counted in small arrays."""
    layouts = [bands_for(threshold, m) for m in range(4, min(threshold + 1, 16) + 1)]
    return [x for x in layouts if max(b.reach(b.radius) << len(b.bits) for b in x) <= _TILE_KEYS]


def _tile_layout(left: np.ndarray, right: np.ndarray, threshold: int) -> list[Band] | None:
    """The cheapest layout for two arrays of hashes by counts of their own band values; None when all pairs cost less."""
    best, best_cost = None, len(left) * len(right) * _PAIR_COST
    if best_cost < _VALUE_COST * 1000:
        return None
    for bands in _tile_layouts(threshold):
        cost = 0.0
        for band in bands:
            width = 1 << len(band.bits)
            own, other = (np.bincount(_values(x, band.bits), minlength=width).astype(np.float64) for x in (left, right))
            every = np.arange(width)
            cost += sum(own @ other[every ^ f] for f in _ball(len(band.bits), band.radius)) * _PAIR_COST
            cost += np.count_nonzero(own) * _VALUE_COST
            if cost >= best_cost:
                break
        if cost < best_cost:
            best, best_cost = bands, cost
    return best


def _banded(left: np.ndarray, right: np.ndarray, threshold: int, bands: list[Band]):
    """What ``_dense`` finds, comparing only hashes that agree in a band up to its radius; each pair comes from its first such band."""
    for n, band in enumerate(bands):
        lv, rv = _values(left, band.bits), _values(right, band.bits)
        rows, columns = left[np.argsort(lv)], right[np.argsort(rv)]
        width, ball = 1 << len(band.bits), _ball(len(band.bits), band.radius)
        first = np.concatenate([[0], np.cumsum(np.bincount(lv, minlength=width))])
        start = np.concatenate([[0], np.cumsum(np.bincount(rv, minlength=width))])
        for value in np.unique(lv).tolist():
            at = start[value ^ ball]
            many = start[(value ^ ball) + 1] - at
            ends = np.cumsum(many)
            near = columns[np.repeat(at - ends + many, many) + np.arange(ends[-1])]
            for a, b, d in _dense(rows[first[value] : first[value + 1]], near, threshold) if len(near) else ():
                fresh = np.ones(len(a), bool)
                for earlier in bands[:n]:
                    fresh &= np.bitwise_count((a ^ b) & np.uint64(earlier.mask & _MASK64)) > earlier.radius
                yield a[fresh], b[fresh], d[fresh]


def _compare(left: np.ndarray, right: np.ndarray, threshold: int, mirrored: bool):
    """Pairs within ``threshold``; unless mirrored only those with left < right."""
    # Unsigned, because numpy counts the bits of the absolute value of a signed number.
    left, right = left.view(np.uint64), right.view(np.uint64)
    bands = _tile_layout(left, right, threshold)
    found, held = [], 0
    for part in _dense(left, right, threshold) if bands is None else _banded(left, right, threshold, bands):
        found.append(part)
        held += len(part[0])
        if held >= _FOUND_ROWS:
            yield from _ordered(found, mirrored)
            found, held = [], 0
    yield from _ordered(found, mirrored)


def _ordered(found: list, mirrored: bool):
    if not found:
        return
    a, b, d = (np.concatenate(x) for x in zip(*found))
    a, b = a.view(np.int64), b.view(np.int64)
    if mirrored:
        a, b = np.minimum(a, b), np.maximum(a, b)
    else:
        keep = a < b
        a, b, d = a[keep], b[keep], d[keep]
    if len(a):
        yield a, b, d.astype(np.int32)


def _compared(threshold: int):
    """Pairs of the items (phash) of two blocks, as batches."""

    def run(left: pa.StructArray, right: pa.StructArray, same: bool):
        lh, rh = struct_field(left, "phash").to_numpy(), struct_field(right, "phash").to_numpy()
        for a, b, d in _compare(lh, rh, threshold, mirrored=not same):
            yield from batches_of([{"a": a, "b": b, "dist": d}], _PAIRS_ARROW)

    return run


def _grid_kernel(threshold: int):
    def run(batches):
        for batch in batches:
            lo, lv = items_of(batch, "left")
            ro, rv = items_of(batch, "right")
            lh = struct_field(lv, "phash").to_numpy()
            rh = struct_field(rv, "phash").to_numpy()
            same = batch.column(batch.schema.get_field_index("same")).to_pylist()
            for r in range(batch.num_rows):
                left, right = lh[lo[r] : lo[r + 1]], rh[ro[r] : ro[r + 1]]
                for a, b, d in _compare(left, right, threshold, mirrored=not same[r]):
                    yield from batches_of([{"a": a, "b": b, "dist": d}], _PAIRS_ARROW)

    return run


def _hot_kernel(threshold: int):
    """Like the grid, but passes the meeting point through for the once-only test in the plan."""
    schema = pa.schema([("band", pa.int8()), ("key", pa.int64()), *_PAIRS_ARROW])

    def run(batches):
        for batch in batches:
            lo, lv = items_of(batch, "left")
            ro, rv = items_of(batch, "right")
            lh = struct_field(lv, "h").to_numpy()
            rh = struct_field(rv, "h").to_numpy()
            mirrored, band, key = (
                batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("mirrored", "band", "key")
            )
            for r in range(batch.num_rows):
                left, right = lh[lo[r] : lo[r + 1]], rh[ro[r] : ro[r + 1]]
                for a, b, d in _compare(left, right, threshold, mirrored[r]):
                    row = {"band": np.full(len(a), band[r]), "key": np.full(len(a), key[r]), "a": a, "b": b, "dist": d}
                    yield from batches_of([row], schema)

    return run


def _hot_pairs(left: DataFrame, right: DataFrame, bands: list[Band], threshold: int) -> DataFrame:
    """Pairs that meet at overfull band values: chunk joins, pruned by the chunks' own band value."""

    def side(df: DataFrame, column: str) -> DataFrame:
        own = _by_band(F.col("band"), [F.col("h").bitwiseAND(F.lit(b.mask)) for b in bands])
        df = df.withColumnRenamed(column, "h").withColumn("own", own)
        return chunked(df, ["band", "key", "own"], "h", ["h"], _BLOCK_ROWS)

    lc = side(left, "a").select("band", "key", F.col("own").alias("lo"), F.col("chunk").alias("lc"), F.col("items").alias("left"))
    rc = side(right, "b").select("band", "key", F.col("own").alias("ro"), F.col("chunk").alias("rc"), F.col("items").alias("right"))
    alike = F.col("lo") == F.col("ro")
    radius = _by_band(F.col("band"), [F.lit(b.radius) for b in bands])
    wanted = F.when(alike, (F.col("key") == F.col("lo")) & (F.col("lc") <= F.col("rc"))).otherwise(
        hamming(F.col("lo"), F.col("ro")) <= radius
    )
    blocks = lc.join(rc, ["band", "key"]).where(wanted)
    blocks = blocks.select(
        "band", "key", "left", "right", (alike & (F.col("lc") != F.col("rc"))).alias("mirrored")
    )
    found = blocks.mapInArrow(_hot_kernel(threshold), "band byte, key long, " + PAIRS_SCHEMA)
    once = _meets_once(bands, F.col("band"), F.col("key"), F.col("a"), F.col("b"))
    return found.where(once).select("a", "b", "dist")


def grid_hamming_pairs(hashes: DataFrame, threshold: int, n: int) -> DataFrame:
    """Pairs by comparing blocks of hashes; the exact way for thresholds that bands cannot prune."""
    pieces = max(1, math.ceil(n / _BLOCK_ROWS), busy_blocks(hashes.sparkSession, n))
    chunks = grid_chunks(hashes, "phash", ["phash"], pieces)
    return grid_pairs(chunks, pieces).mapInArrow(_grid_kernel(threshold), PAIRS_SCHEMA)


def hash_partition(hashes: DataFrame, threshold: int, n: int, block_rows: int = _BLOCK_ROWS) -> Partition:
    """Blocks of near hashes of a stored table (phash), and the pairs of blocks that may hold a pair."""
    band_rows = min(_BAND_ROWS, max(_BLOCK_ROWS, -(-n // max(1, busy_blocks(hashes.sparkSession, n)))))
    return partitioned(hashes, "phash", "phash", ["phash"], HAMMING, threshold, n, block_rows, band_rows, packed=True)


def pivot_hamming_pairs(hashes: DataFrame, threshold: int, n: int, block_rows: int = _BLOCK_ROWS) -> DataFrame:
    """Pairs by comparing only those blocks that the triangle inequality does not keep apart."""
    return hash_partition(hashes, threshold, n, block_rows).compared(_compared(threshold), PAIRS_SCHEMA, whole_from=0.1)


def band_hamming_pairs(
    hashes: DataFrame, threshold: int, bands: list[Band], hot_rows: int = HOT_BAND_ROWS, check_hot: bool = True
) -> DataFrame:
    """Pairs by equi-join on band values."""
    left, right = _probe(hashes, bands, "left", "a"), _probe(hashes, bands, "right", "b")
    hot_part = None
    if check_hot:
        flat = [Band(b.bits, 0, 0) for b in bands]
        hot = _probe(hashes, flat, "left", "h").groupBy("band", "key").count().where(F.col("count") > hot_rows)
        hot = materialize(hot.select("band", F.col("key").alias("own")), "hot-bands")
        if not is_empty(hot):
            flips = _by_band(
                F.col("band"),
                [_longs(b.flips(max(b.left, b.right))) for b in bands],
            )
            keys = hot.select("band", F.explode(F.transform(flips, lambda f: F.col("own").bitwiseXOR(f))).alias("key"))
            keys = materialize(keys.distinct(), "hot-keys")
            hot_part = _hot_pairs(
                left.join(keys, ["band", "key"], "left_semi"),
                right.join(keys, ["band", "key"], "left_semi"),
                bands,
                threshold,
            )
            left = left.join(keys, ["band", "key"], "left_anti")
            right = right.join(keys, ["band", "key"], "left_anti")
    a, b = F.col("a"), F.col("b")
    # The planner takes the listed keys to be as small as the hashes they come from; they must not be broadcast.
    joined = left.join(right.hint("merge"), ["band", "key"]).where(
        (a < b) & (hamming(a, b) <= threshold) & _meets_once(bands, F.col("band"), F.col("key"), a, b)
    )
    pairs = joined.select("a", "b", hamming(a, b).alias("dist"))
    return pairs.unionByName(hot_part) if hot_part is not None else pairs


def hamming_pairs(
    hashes: DataFrame, threshold: int, hot_rows: int = HOT_BAND_ROWS, collapsed: bool = False
) -> DataFrame:
    """All pairs ``a < b`` of distinct hashes with distance at most ``threshold`` -> (a, b, dist).

    ``hashes`` needs a ``phash`` column; equal hashes are collapsed first, so a family of copies is one row.
    ``collapsed`` tells that they are, in a stored table.
    """
    distinct = hashes.select("phash")
    if not collapsed:
        distinct = materialize(distinct.where(F.col("phash").isNotNull()).distinct(), "hashes")
    n = distinct.count()
    bands = choose_bands(threshold, n)
    if bands is None:
        return pivot_hamming_pairs(distinct, threshold, n) if n > PIVOT_ROWS else grid_hamming_pairs(distinct, threshold, n)
    return band_hamming_pairs(distinct, threshold, bands, hot_rows, check_hot=n > hot_rows)


def two_band_pairs(hashes: DataFrame, threshold: int, suspect_max: int, collapsed: bool = False) -> DataFrame:
    """One search at the wider limit, split into sure and suspect pairs -> (a, b, dist, sure)."""
    return hamming_pairs(hashes, suspect_max, collapsed=collapsed).withColumn("sure", F.col("dist") <= threshold)
