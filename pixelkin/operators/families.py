"""Complete linkage of a component from the values of its points, in one task.

The pairs of a family grow with the square of its size. Here its points go to one task, which works their pairs out block by
block, so that no pair is stored, joined or shuffled. Which clusters agree is a matrix of one bit for each two of them. The
result is that of one ordered pass over all pairs, as in ``linkage``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelkin.config import DedupConfig
from pixelkin.operators.chunks import batches_of
from pixelkin.operators.components import local_labels

DIGITS = 9
# Orders of pairs: by differing bits, by falling cosine, or by the places of their points alone; places part equal ones.
BITS, COSINE, PLACE = "bits", "cosine", "place"
# Components of so many points are worked out together with others, as one flat list of pairs.
_SMALL = 64
# Values of a block of pairs, and pairs that are put in order at once.
_BLOCK_VALUES, _ORDERED_PAIRS = 1 << 21, 1 << 22
# Pairs that are looked at together for the next merge, at least and at most.
_LOOK = (256, 1 << 15)
# Bytes that an edge in maps takes, so that a task has the space of ``component_edge_limit`` edges.
MAP_BYTES = 400
# Bytes of a task, of a point besides its vector, and of a number of its vector.
_FIXED_BYTES, _POINT_BYTES, _NUMBER_BYTES = 20_000, 100, 24


@dataclass(frozen=True)
class Likeness:
    """Which points are similar, which similar pairs may start a merge, and the order of these.

    Similar points have at most ``bits`` differing bits and at least the cosine ``cosine`` (None: whatever they have). A pair
    may start a merge if it differs in more than ``above`` bits and, where points have one, in its unit.
    """

    order: str
    bits: int | None = None
    cosine: float | None = None
    above: int = -1

    @property
    def least(self) -> int:
        """The least cosine in units of the last digit, rounded as everywhere."""
        scale = 10.0**DIGITS
        least = int(np.ceil(self.cosine * scale))
        while (least - 1) / scale >= self.cosine:
            least -= 1
        while least / scale < self.cosine:
            least += 1
        return least


@dataclass(frozen=True)
class Family:
    """Points of the clusters to be merged, and links between them that hold every pair that may start a merge.

    ``links``: (a, b) over the nodes of points; ``points``: (node, cid, w, phash, vector, unit, ...), of which a likeness
    needs phash or vector; a missing unit differs from all. ``places``: the columns that order the points.
    """

    links: DataFrame
    points: DataFrame
    places: list[str]
    likeness: Likeness


def fits(points: F.Column, width: F.Column, limit: int) -> F.Column:
    """Whether a task of ``limit`` bytes holds so many points with vectors of that width, and a bit for each two of them."""
    n = points.cast("double")
    return n * n / 8 + n * (_POINT_BYTES + _NUMBER_BYTES * width) + _FIXED_BYTES <= limit


def task_bytes(cfg: DedupConfig) -> int:
    return cfg.component_edge_limit * MAP_BYTES


def hopeless(limit: int) -> bool:
    """A task of so many bytes holds nothing."""
    return limit <= _FIXED_BYTES


class _Points:
    """Values of points in the order of their places."""

    def __init__(self, batch: pa.RecordBatch, likeness: Likeness):
        self.like, self.n, names = likeness, batch.num_rows, batch.schema.names
        self.hashes = batch.column("phash").to_numpy().view(np.uint64) if "phash" in names else None
        self.units = batch.column("unit").dictionary_encode().indices.to_numpy() if "unit" in names else None
        self.least = likeness.least if likeness.cosine is not None else None
        if likeness.cosine is not None:
            column = batch.column("vector")
            self.widths = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False)
            wide = int(self.widths.max())
            self.even = bool((self.widths == wide).all())
            if self.even:
                self.vectors = flat.astype(np.float64).reshape(self.n, wide)
            else:
                self.vectors = np.zeros((self.n, wide))
                self.vectors[np.arange(wide) < self.widths[:, None]] = flat

    def _judged(self, bits, cosines, even):
        """(similar, may start) from differing bits and cosines in units of the last digit."""
        similar = even
        if self.like.bits is not None:
            similar = similar & (bits <= self.like.bits)
        if cosines is not None:
            similar = similar & (cosines >= self.least)
        return similar, similar & (bits > self.like.above) if self.like.above >= 0 else similar

    def pairs(self, i: np.ndarray, j: np.ndarray):
        """(similar, may start, bits, cosines) of single pairs."""
        bits, cosines, even = None, None, np.ones(len(i), bool)
        if self.hashes is not None:
            bits = np.bitwise_count(self.hashes[i] ^ self.hashes[j])
        if self.least is not None:
            cosines, step = np.zeros(len(i)), max(1, _BLOCK_VALUES // 4 // max(1, self.vectors.shape[1]))
            for k in range(0, len(i), step):
                part = slice(k, k + step)
                cosines[part] = np.einsum("ij,ij->i", self.vectors[i[part]], self.vectors[j[part]])
            cosines, even = np.rint(cosines * 10.0**DIGITS), self.widths[i] == self.widths[j]
        similar, starts = self._judged(bits, cosines, even)
        return similar, self._units_differ(starts, i, j), bits, cosines

    def _units_differ(self, starts, i, j):
        return starts & (self.units[i] != self.units[j]) if self.units is not None else starts

    def block(self, rows, columns):
        """(similar, may start, bits, cosines) of all pairs of two slices or lists of points."""
        bits, cosines, even = None, None, np.True_
        if self.hashes is not None:
            bits = np.bitwise_count(self.hashes[rows, None] ^ self.hashes[None, columns])
        if self.least is not None:
            cosines = self.vectors[rows] @ self.vectors[columns].T
            cosines *= 10.0**DIGITS
            np.rint(cosines, out=cosines)
            if not self.even:
                even = self.widths[rows, None] == self.widths[None, columns]
        similar, starts = self._judged(bits, cosines, even)
        if self.units is not None:
            starts = starts & (self.units[rows, None] != self.units[None, columns])
        return similar, starts, bits, cosines

    def above(self):
        """Blocks of the pairs of a point with later ones: (first row, first column, may start, bits, cosines)."""
        step = max(1, _BLOCK_VALUES // self.n)
        for at in range(0, self.n, step):
            _, starts, bits, cosines = self.block(slice(at, at + step), slice(at, self.n))
            yield at, np.triu(starts, 1), bits, cosines


def _found(at: int, mask: np.ndarray):
    i, j = np.divmod(np.flatnonzero(mask), mask.shape[1])
    return i + at, j + at


class _Merger:
    """Clusters 0..m-1 that merge along pairs offered in order, where all their points are similar."""

    def __init__(self, points: _Points, codes: np.ndarray, weights: np.ndarray):
        self.codes, self.m = codes, len(weights)
        self.home, self.members = np.arange(self.m), [[c] for c in range(self.m)]
        self.weights = weights.copy()
        self.agree = self._matrix(points)

    def _matrix(self, points: _Points) -> np.ndarray:
        order = np.argsort(self.codes, kind="stable")
        codes = self.codes[order]
        starts = np.searchsorted(codes, np.arange(self.m))
        single = self.m == points.n
        apart = np.zeros((self.m, -(-self.m // 8)), np.uint8)
        step = max(1, _BLOCK_VALUES // points.n)
        for at in range(0, points.n, step):
            away = ~points.block(order[at : at + step], order)[0]
            if not single:
                away = np.logical_or.reduceat(away, starts, axis=1)
            rows = np.packbits(away, axis=1, bitorder="little")
            own = codes[at : at + step]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            apart[own[first]] |= np.bitwise_or.reduceat(rows, first, axis=0)
        return ~apart

    def _may(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a != b) & ((self.agree[a, b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)

    def wanted(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs of points could still merge their clusters; the others never will."""
        return self._may(self.home[self.codes[i]], self.home[self.codes[j]])

    def offer(self, i: np.ndarray, j: np.ndarray) -> None:
        kept = self.wanted(i, j)
        a, b = self.codes[i[kept]], self.codes[j[kept]]
        at, step = 0, _LOOK[0]
        while at < len(a):
            ca, cb = self.home[a[at : at + step]], self.home[b[at : at + step]]
            may = self._may(ca, cb)
            next_one = int(may.argmax())
            if not may[next_one]:
                at, step = at + step, min(2 * step, _LOOK[1])
                continue
            at, step = at + next_one + 1, max(_LOOK[0], next_one)
            self._merge(int(ca[next_one]), int(cb[next_one]))

    def _merge(self, first: int, second: int) -> None:
        keep, gone = (second, first) if self.weights[first] <= self.weights[second] else (first, second)
        self.home[self.members[gone]] = keep
        self.members[keep] += self.members[gone]
        self.members[gone] = []
        self.weights[keep] += self.weights[gone]
        row = self.agree[keep] & self.agree[gone]
        self.agree[keep] = row
        bit = np.uint8(1 << (keep & 7))
        column = self.agree[:, keep >> 3]
        column &= ~bit
        column |= np.unpackbits(row, count=self.m, bitorder="little") * bit


def _by_cosine(points: _Points, merger: _Merger, low: int, high: int | None, count: int | None) -> None:
    """Offers the pairs of cosines from ``low`` to below ``high``, about ``count`` of them, a bounded number at a time."""

    def blocks():
        for at, starts, _, cosines in points.above():
            starts &= cosines >= low
            if high is not None:
                starts &= cosines < high
            i, j = _found(at, starts)
            kept = merger.wanted(i, j)
            i, j = i[kept], j[kept]
            yield i, j, cosines[i - at, j - at].astype(np.int64)

    if count is not None and count <= _ORDERED_PAIRS:
        found = list(blocks())
        if found:
            i, j, cosine = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((j, i, -cosine))
            merger.offer(i[order], j[order])
        return
    if high is not None and high - low <= 1:
        for i, j, _ in blocks():
            merger.offer(i, j)
        return
    if high is None:
        end = max((int(cosine.max()) + 1 for _, _, cosine in blocks() if len(cosine)), default=low)
        if end <= low:
            return
        high = end
    edges = np.unique(np.linspace(low, high, 257).astype(np.int64))
    many = np.zeros(len(edges) - 1, np.int64)
    for _, _, cosine in blocks():
        many += np.histogram(cosine, edges)[0]
    # The last edge of a histogram is inside; no cosine reaches it.
    end = len(many)
    while end:
        first, held = end - 1, int(many[end - 1])
        while first and held + many[first - 1] <= _ORDERED_PAIRS:
            first -= 1
            held += int(many[first])
        if held:
            _by_cosine(points, merger, int(edges[first]), int(edges[end]), held)
        end = first


def _merged_large(points: _Points, codes: np.ndarray, weights: np.ndarray) -> list[list[int]]:
    merger = _Merger(points, codes, weights)
    if points.like.order == COSINE:
        _by_cosine(points, merger, points.least, None, None)
    elif points.like.order == PLACE:
        for at, starts, _, _ in points.above():
            merger.offer(*_found(at, starts))
    else:
        for distance in range(max(0, points.like.above + 1), points.like.bits + 1):
            for at, starts, bits, _ in points.above():
                merger.offer(*_found(at, starts & (bits == distance)))
    return [m for m in merger.members if m]


def greedy_merge(a, b, links, initiating, points, weights):
    """Merge clusters 0..n-1 along edges in the given order -> member lists in merge order.

    ``links[c][d]`` counts similar cross pairs and is consumed.
    """
    home = list(range(len(points)))
    members = [[c] for c in home]
    for first, second, may_start in zip(a, b, initiating):
        ca, cb = home[first], home[second]
        if not may_start or ca == cb or links[ca].get(cb, 0) != points[ca] * points[cb]:
            continue
        keep, gone = (cb, ca) if weights[ca] <= weights[cb] else (ca, cb)
        for m in members[gone]:
            home[m] = keep
        members[keep] += members[gone]
        members[gone] = []
        points[keep] += points[gone]
        weights[keep] += weights[gone]
        for other, count in links[gone].items():
            del links[other][gone]
            if other != keep:
                links[keep][other] = links[other][keep] = links[keep].get(other, 0) + count
        links[gone] = {}
    return [m for m in members if m]


def _flat(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of the points of components that follow each other."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    many = ends - np.arange(len(ends)) - 1
    i = np.repeat(np.arange(len(ends)), many)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + i + 1


def _merged_small(points: _Points, sizes: np.ndarray, codes: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> list[list[int]]:
    i, j = _flat(sizes)
    similar, starts, bits, cosines = points.pairs(i, j)
    a, b = codes[i[similar]], codes[j[similar]]
    a, b = a[a != b], b[a != b]
    both, links = np.unique(np.minimum(a, b) * len(counts) + np.maximum(a, b), return_counts=True)
    held: list[dict] = [{} for _ in counts]
    for x, y, c in zip((both // len(counts)).tolist(), (both % len(counts)).tolist(), links.tolist()):
        held[x][y] = held[y][x] = c
    i, j = i[starts], j[starts]
    if points.like.order == COSINE:
        order = np.lexsort((j, i, -cosines[starts]))
    else:
        order = np.lexsort((j, i, bits[starts])) if points.like.order == BITS else np.arange(len(i))
    a, b = codes[i[order]], codes[j[order]]
    return greedy_merge(a.tolist(), b.tolist(), held, [True] * len(a), counts.tolist(), weights.tolist())


def _merge_rows(batch: pa.RecordBatch, sizes: np.ndarray, likeness: Likeness):
    """Whole components, one after the other, -> columns (cid, final, seq)."""
    points = _Points(batch, likeness)
    encoded = batch.column("cid").dictionary_encode()
    codes, names = encoded.indices.to_numpy().astype(np.int64), encoded.dictionary
    counts = np.bincount(codes, minlength=len(names))
    weights = np.zeros(len(names), np.int64)
    np.add.at(weights, codes, batch.column("w").to_numpy())
    if len(sizes) == 1 and sizes[0] > _SMALL:
        groups = _merged_large(points, codes, weights)
    else:
        groups = _merged_small(points, sizes, codes, counts, weights)
    order = np.array([m for g in groups for m in g])
    many = np.array([len(g) for g in groups])
    first = np.cumsum(many) - many
    before = np.cumsum(counts[order]) - counts[order]
    yield {
        "cid": names.take(pa.array(order)),
        "final": names.take(pa.array(np.repeat(order[first], many))),
        "seq": before - np.repeat(before[first], many),
    }


def _link_rows(batch: pa.RecordBatch, sizes: np.ndarray, likeness: Likeness):
    """Whole components -> columns (a, b): what hangs together by pairs that may start a merge, as few links."""
    points = _Points(batch, likeness)
    encoded = batch.column("cid").dictionary_encode()
    codes, names = encoded.indices.to_numpy().astype(np.int64), encoded.dictionary
    labels = np.arange(len(names))
    if len(sizes) == 1 and sizes[0] > _SMALL:
        for at, starts, _, _ in points.above():
            i, j = _found(at, starts)
            labels = local_labels(labels[codes[i]], labels[codes[j]], len(names))[labels]
    else:
        i, j = _flat(sizes)
        starts = points.pairs(i, j)[1]
        labels = local_labels(codes[i[starts]], codes[j[starts]], len(names))
    own = np.flatnonzero(labels != np.arange(len(names)))
    # Spark takes an empty batch for the end.
    if len(own):
        yield {"a": names.take(pa.array(own)), "b": names.take(pa.array(labels[own]))}


def _by_component(work, likeness: Likeness, schema: pa.Schema):
    """Calls ``work`` with whole components: a large one alone, small ones together."""

    def worked(table: pa.Table):
        batch = table.combine_chunks().to_batches()[0]
        component = batch.column("component").dictionary_encode().indices.to_numpy()
        starts = np.flatnonzero(np.diff(component, prepend=-1))
        sizes = np.diff(starts, append=len(component))
        at = 0
        while at < len(sizes):
            end = at + 1
            while sizes[at] <= _SMALL and end < len(sizes) and sizes[end] <= _SMALL:
                end += 1
            rows = batch.slice(int(starts[at]), int(sizes[at:end].sum()))
            # A slice of a list column keeps its offsets; a copy of its own does not.
            rows = pa.Table.from_batches([rows]).take(pa.array(np.arange(rows.num_rows))).combine_chunks().to_batches()[0]
            for found in work(rows, sizes[at:end], likeness):
                yield from batches_of([found], schema)
            at = end

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            component = batch.column("component")
            last = component[-1]
            if component[0].as_py() == last.as_py():
                if held and held[-1].column("component")[-1].as_py() != last.as_py():
                    yield from worked(pa.Table.from_batches(held))
                    held = []
                held.append(batch)
                continue
            codes = component.dictionary_encode().indices.to_numpy()
            cut = int(np.flatnonzero(np.diff(codes))[-1]) + 1
            yield from worked(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = [batch.slice(cut)]
        if held:
            yield from worked(pa.Table.from_batches(held))

    return run


def whole_components(rows: DataFrame) -> DataFrame:
    """Rows dealt out so that a component is in one task.

    A plain column would not do: after a join on it Spark leaves the exchange out, and may then read the join's own shuffle
    in other parts.
    """
    return rows.repartition(F.xxhash64("component"))


def _dealt(points: DataFrame, places: list[str]) -> DataFrame:
    used = [c for c in ("phash", "vector", "unit") if c in points.columns]
    return whole_components(points).sortWithinPartitions("component", *places).select("component", "cid", "w", *used)


def merge_families(points: DataFrame, places: list[str], likeness: Likeness) -> DataFrame:
    """(cid, final, seq) of all clusters of ``points`` with ``component``, each component in one task."""
    kind = points.schema["cid"].dataType
    schema = T.StructType([T.StructField("cid", kind), T.StructField("final", kind), T.StructField("seq", T.LongType())])
    return _dealt(points, places).mapInArrow(_by_component(_merge_rows, likeness, _arrow(schema)), schema)


def start_links(points: DataFrame, places: list[str], likeness: Likeness) -> DataFrame:
    """(a, b) over the clusters of ``points``: as few links as tell which clusters pairs that may start a merge connect."""
    kind = points.schema["cid"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    return _dealt(points, places).mapInArrow(_by_component(_link_rows, likeness, _arrow(schema)), schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string()}
    return pa.schema([(f.name, kinds[f.dataType]) for f in schema])
