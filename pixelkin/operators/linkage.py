"""Complete-linkage merging of clusters along ranked similar pairs.

Two clusters may merge when every cross pair is similar, that is when the number of similar cross pairs
equals the product of their point counts. Pairs are taken in the order of their key. A merge never leaves
a connected component of the initiating pairs, so components are independent of each other:

* a component whose clusters are all mutually similar is one group, whatever the order;
* a component of bounded size is merged in one task, a dense one in a matrix, which holds more edges;
* any larger one is merged level by level. Components that have become small enough for one task are settled first; in the
  others every cluster points at its first choice, and what hangs together by first choices is a group. The least rank of a
  pair that leaves a group bounds what nothing outside can precede: a group of bounded size is settled in one task below
  that rank. Groups beyond that are cut at a quantile of the ranks of their choices; in those that are still too large,
  every cluster pair that is the first choice of both sides merges. After each level, edges of merged clusters are folded
  and incompatible ones dropped.

All three give the result of one sequential pass over the whole pair list. Where the caller gives the points themselves, a
component of bounded size is merged from them (``families``), and edges are only made for larger ones.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelkin.config import DedupConfig
from pixelkin.operators.chunks import batches_of
from pixelkin.operators.components import connected
from pixelkin.operators.families import MAP_BYTES, Family, fits, greedy_merge, hopeless, merge_families, task_bytes, whole_components
from pixelkin.session import is_empty, materialize

_SIZES = ("na", "nb", "wa", "wb")
# Columns of an edge between two clusters. ``a`` is the cluster that holds the first file of the best
# initiating pair, ``k`` that pair's rank (null when no pair may initiate a merge), ``cnt`` the similar
# cross pairs, ``n*`` the points and ``w*`` the files of each side.
EDGE_COLUMNS = ["a", "b", "na", "nb", "wa", "wb", "cnt", "k"]
# Ranks that a bound is picked from, and the smallest part of the pairs that a level takes.
_SAMPLE_RANKS = 1024
_LEAST_SHARE = 1.0 / 64
# Edges of a group that a level settles in one task, if a component may not have more.
_GROUP_EDGES = 100_000
# Links are counted in a square matrix where it has no more places than this for each edge, and in maps elsewhere.
_MATRIX_SHARE = 64
# Edges that are looked at together for the next merge, at least and at most.
_LOOK = (256, 1 << 15)
# Edges in maps take about so many bytes each. A matrix takes a fixed part, 4 bytes a place and 17 bytes an edge, so that a task
# holds more edges of a dense component in the space that ``component_edge_limit`` edges would take.
_FIXED_BYTES, _PLACE_BYTES, _EDGE_BYTES = 20_000, 4, 17


def cluster_edges(point_pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Fold similar point pairs into edges between clusters.

    ``point_pairs``: (a, b, k) with ``a`` the cluster of the first point and ``k`` null for pairs that
    only count; ``clusters``: (cid, n, w).
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    folded = (
        point_pairs.where(F.col("a") != F.col("b"))
        .withColumn("best", F.when(F.col("k").isNotNull(), F.struct("k", "a", "b")))
        .groupBy(low.alias("x"), high.alias("y"))
        .agg(F.count("*").alias("cnt"), F.min("best").alias("best"))
    )
    sided = folded.select(
        F.coalesce("best.a", "x").alias("a"), F.coalesce("best.b", "y").alias("b"), "cnt", F.col("best.k").alias("k")
    )
    for side in ("a", "b"):
        sizes = clusters.select(
            F.col("cid").alias(side), F.col("n").alias(f"n{side}"), F.col("w").alias(f"w{side}")
        )
        sided = sided.join(sizes, side)
    return sided.select(*EDGE_COLUMNS)


def _matrix_merge(a, b, links, initiating, points, weights):
    """What ``greedy_merge`` gives, from a square matrix of links; many edges at once are looked at for the next merge."""
    home, members, at, step = np.arange(len(points)), [[c] for c in range(len(points))], 0, _LOOK[0]
    while at < len(a):
        ca, cb = home[a[at : at + step]], home[b[at : at + step]]
        may = (ca != cb) & (links[ca, cb] == points[ca] * points[cb]) & initiating[at : at + step]
        next_one = int(may.argmax())
        if not may[next_one]:
            at, step = at + step, min(2 * step, _LOOK[1])
            continue
        at, step = at + next_one + 1, max(_LOOK[0], next_one)
        first, second = int(ca[next_one]), int(cb[next_one])
        keep, gone = (second, first) if weights[first] <= weights[second] else (first, second)
        home[members[gone]] = keep
        members[keep] += members[gone]
        members[gone] = []
        points[keep] += points[gone]
        weights[keep] += weights[gone]
        links[keep] += links[gone]
        links[:, keep] += links[:, gone]
    return [m for m in members if m]


class _Gathered:
    """Edges of whole components, in order, as numbers: clusters by their place of first appearance."""

    def __init__(self):
        self.places, self.names, self.points, self.weights = {}, [], [], []
        self.columns: list[list[np.ndarray]] = [[], [], [], []]

    def add(self, batch: pa.RecordBatch) -> None:
        sides = [batch.column("a"), batch.column("b")]
        names = pa.concat_arrays(sides).dictionary_encode()
        codes, known = names.indices.to_numpy(), len(self.places)
        places = np.array([self.places.setdefault(x, len(self.places)) for x in names.dictionary.to_pylist()], np.int32)
        self.names.append(names.dictionary.filter(pa.array(places >= known)))
        for found, field in ((self.points, "n"), (self.weights, "w")):
            of = np.zeros(len(places), np.int64)
            of[codes] = np.concatenate([batch.column(f"{field}{side}").to_numpy() for side in "ab"])
            found.append(of[places >= known])
        a, b = np.split(places[codes], 2)
        count = batch.column("cnt").to_numpy()
        if len(count) and count.max() < 1 << 31:
            count = count.astype(np.int32)
        for column, part in zip(self.columns, (a, b, count, batch.column("init").to_numpy(zero_copy_only=False))):
            column.append(part)

    def merged(self):
        """Batches of (cid, final, seq)."""
        # One column after the other gives its parts back.
        a, b, count, init = (np.concatenate(self.columns.pop(0)) for _ in range(4))
        names, points, weights = pa.concat_arrays(self.names), np.concatenate(self.points), np.concatenate(self.weights)
        n, own = len(points), points.copy()
        if n * n <= _MATRIX_SHARE * len(a):
            small = points.sum() < 1 << 16
            links = np.zeros((n, n), np.int32 if small else np.int64)
            for k in range(0, len(a), _LOOK[1]):
                part = slice(k, k + _LOOK[1])
                links[a[part], b[part]] = links[b[part], a[part]] = count[part]
            groups = _matrix_merge(a, b, links, init, points, weights)
        else:
            links = [{} for _ in range(n)]
            for x, y, c in zip(a.tolist(), b.tolist(), count.tolist()):
                links[x][y] = links[y][x] = c
            groups = greedy_merge(a.tolist(), b.tolist(), links, init.tolist(), points.tolist(), weights.tolist())
        order = np.array([m for g in groups for m in g])
        sizes = np.array([len(g) for g in groups])
        first = np.cumsum(sizes) - sizes
        before = np.cumsum(own[order]) - own[order]
        out = {
            "cid": names.take(pa.array(order)),
            "final": names.take(pa.array(np.repeat(order[first], sizes))),
            "seq": before - np.repeat(before[first], sizes),
        }
        return batches_of([out], pa.schema([("cid", names.type), ("final", names.type), ("seq", pa.int64())]))


def _merge_kernel(batches):
    """Edges, those of a component one after the other and in order -> (cid, final, seq).

    Components share no cluster, so the whole ones of a batch are merged in one pass.
    """
    held, unfinished = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        component = batch.column("component")
        starts = np.flatnonzero(pc.not_equal(component.slice(1), component.slice(0, len(component) - 1))) + 1
        first, last = (int(starts[0]), int(starts[-1])) if len(starts) else (0, 0)
        if held and component[0].as_py() != unfinished:
            yield from held.merged()
            held = None
        if held and last:
            held.add(batch.slice(0, first))
            yield from held.merged()
            held = None
        else:
            first = 0
        if last > first:
            whole = _Gathered()
            whole.add(batch.slice(first, last - first))
            yield from whole.merged()
        held = held or _Gathered()
        held.add(batch.slice(last))
        unfinished = component[-1].as_py()
    if held:
        yield from held.merged()


def _merge_bounded(edges: DataFrame, id_type: T.DataType) -> DataFrame:
    """Components of bounded size (a, b, ..., component), each in one task.

    The shuffle brings the edges in order: sorting them as arrays took most of the time of a large component.
    """
    dealt = whole_components(edges.select("component", "k", "a", "b", *_SIZES, "cnt"))
    ordered = dealt.sortWithinPartitions("component", "k", "a", "b").select(
        "component", "a", "b", *_SIZES, "cnt", F.col("k").isNotNull().alias("init")
    )
    schema = T.StructType(
        [T.StructField("cid", id_type), T.StructField("final", id_type), T.StructField("seq", T.LongType())]
    )
    return ordered.mapInArrow(_merge_kernel, schema)


def _fits_task(nodes: F.Column, edges: F.Column, limit: int) -> F.Column:
    """One task may hold a component: ``limit`` edges in maps, or as many bytes of a matrix."""
    places = nodes.cast("double") * nodes
    space = places * _PLACE_BYTES + edges * _EDGE_BYTES + _FIXED_BYTES
    return (edges <= limit) | ((places <= edges * _MATRIX_SHARE) & (space <= limit * MAP_BYTES))


def _live(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("cnt") == F.col("na") * F.col("nb"))


def _agreed_moves(starters: DataFrame) -> DataFrame:
    """Moves (old, new, shift, size) for the cluster pairs that are the first choice of both sides."""
    choice = F.struct("k", "a", "b", *_SIZES)
    ends = starters.select(F.explode(F.array("a", "b")).alias("c"), choice.alias("m"))
    best = ends.groupBy("c").agg(F.min("m").alias("m"))
    agreed = best.groupBy("m").count().where(F.col("count") == 2).select("m.*")
    a_keeps = F.col("wa") > F.col("wb")
    merged = F.struct((F.col("na") + F.col("nb")).alias("n"), (F.col("wa") + F.col("wb")).alias("w"))
    none = F.lit(0).cast("long")
    sides = [("a", F.when(a_keeps, none).otherwise(F.col("nb"))), ("b", F.when(a_keeps, F.col("na")).otherwise(none))]
    return agreed.select(
        F.explode(
            F.array(
                *(
                    F.struct(
                        F.col(side).alias("old"), F.when(a_keeps, F.col("a")).otherwise(F.col("b")).alias("new"),
                        shift.alias("shift"), merged.alias("size"),
                    )
                    for side, shift in sides
                )
            )
        ).alias("e")
    ).select("e.old", "e.new", "e.shift", "e.size")


def _settled_moves(inside: DataFrame, id_type: T.DataType) -> DataFrame:
    """Moves of all merges inside bounded components (edges with ``component``; a null key may not start a merge)."""
    ends = inside.select(F.explode(F.array(*(F.struct(F.col(x).alias("cid"), F.col(f"n{x}").alias("n"), F.col(f"w{x}").alias("w")) for x in "ab"))).alias("e"))
    sizes = ends.select("e.*").groupBy("cid").agg(F.first("n").alias("n"), F.first("w").alias("w"))
    merged = _merge_bounded(inside, id_type).join(sizes, "cid")
    totals = merged.groupBy("final").agg(F.struct(F.sum("n").alias("n"), F.sum("w").alias("w")).alias("size"), F.count("*").alias("many"))
    return merged.join(totals.where("many > 1"), "final").select(
        F.col("cid").alias("old"), F.col("final").alias("new"), F.col("seq").alias("shift"), "size"
    )


def _moved(edges: DataFrame, placed: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and places (cid, current, seq) after the moves."""
    for side in ("a", "b"):
        step = moves.select(F.col("old").alias(side), F.col("new").alias("_new"), F.col("size").alias("_size"))
        edges = edges.join(step, side, "left").withColumns(
            {
                side: F.coalesce("_new", side),
                f"n{side}": F.coalesce("_size.n", f"n{side}"),
                f"w{side}": F.coalesce("_size.w", f"w{side}"),
            }
        ).drop("_new", "_size")
    first_low = F.col("a") < F.col("b")
    sizes = F.when(first_low, F.struct(F.col("na").alias("nx"), F.col("nb").alias("ny"), F.col("wa").alias("wx"), F.col("wb").alias("wy"))).otherwise(
        F.struct(F.col("nb").alias("nx"), F.col("na").alias("ny"), F.col("wb").alias("wx"), F.col("wa").alias("wy"))
    )
    folded = (
        edges.where(F.col("a") != F.col("b"))
        .withColumn("best", F.when(F.col("k").isNotNull(), F.struct("k", "a", "b")))
        .groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        .agg(F.sum("cnt").alias("cnt"), F.min("best").alias("best"), F.max(sizes).alias("s"))
    )
    a_is_x = F.coalesce(F.col("best.a") == F.col("x"), F.lit(True))
    folded = folded.select(
        F.when(a_is_x, F.col("x")).otherwise(F.col("y")).alias("a"),
        F.when(a_is_x, F.col("y")).otherwise(F.col("x")).alias("b"),
        F.when(a_is_x, F.col("s.nx")).otherwise(F.col("s.ny")).alias("na"),
        F.when(a_is_x, F.col("s.ny")).otherwise(F.col("s.nx")).alias("nb"),
        F.when(a_is_x, F.col("s.wx")).otherwise(F.col("s.wy")).alias("wa"),
        F.when(a_is_x, F.col("s.wy")).otherwise(F.col("s.wx")).alias("wb"),
        "cnt",
        F.col("best.k").alias("k"),
    )
    return materialize(_live(folded), "linkage-edges"), _replaced(placed, moves)


def _replaced(placed: DataFrame, moves: DataFrame) -> DataFrame:
    """Places (cid, current, seq) after the moves."""
    placed = placed.join(moves.select(F.col("old").alias("current"), "new", "shift"), "current", "left").select(
        "cid", F.coalesce("new", "current").alias("current"), (F.col("seq") + F.coalesce("shift", F.lit(0))).alias("seq")
    )
    return materialize(placed, "linkage-placed")


def _literal(value, kind: T.DataType) -> F.Column:
    if isinstance(kind, T.StructType):
        return F.struct(*(_literal(value[f.name], f.dataType).alias(f.name) for f in kind.fields))
    return F.lit(value).cast(kind)


def _bound(starters: DataFrame, share: float) -> F.Column:
    """A rank that about this share of the pairs does not exceed, from a bounded sample of them."""
    sample = starters.orderBy(F.xxhash64("a", "b")).select("k").limit(_SAMPLE_RANKS).collect()
    ranks = sorted(r["k"] for r in sample)
    chosen = ranks[min(len(ranks) - 1, int(share * len(ranks)))]
    return _literal(chosen, starters.schema["k"].dataType)


def _in_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in one component of ``nodes`` (node, component)."""
    inside = edges.join(nodes.select(F.col("node").alias("a"), "component"), "a")
    inside = inside.join(nodes.select(F.col("node").alias("b"), F.col("component").alias("other")), "b")
    return inside.where(F.col("component") == F.col("other")).drop("other")


def _choices(starters: DataFrame) -> DataFrame:
    """The pairs (a, b, k) that are the first choice of one of their sides."""
    choice = F.struct("k", "a", "b")
    best = starters.select(F.explode(F.array("a", "b")).alias("c"), choice.alias("m")).groupBy("c").agg(F.min("m").alias("m"))
    return best.select("m.a", "m.b", "m.k").distinct()


def _tagged(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the groups of ``nodes`` (node, component) that their ends are in (ga, gb)."""
    for side in ("a", "b"):
        edges = edges.join(nodes.select(F.col("node").alias(side), F.col("component").alias(f"g{side}")), side, "left")
    return materialize(edges, "level-edges")


def _inside(tagged: DataFrame) -> DataFrame:
    return tagged.where(F.col("ga") == F.col("gb")).withColumnRenamed("ga", "component").drop("gb")


def _too_large(tagged: DataFrame, nodes: DataFrame, cfg: DedupConfig) -> DataFrame:
    """(component) of the groups with more edges than one task should hold."""
    limit = max(cfg.component_edge_limit, _GROUP_EDGES)
    counts = _inside(tagged).groupBy("component").agg(F.count("*").alias("edges")).where(F.col("edges") > limit)
    members = nodes.join(counts, "component").groupBy("component", "edges").agg(F.count("*").alias("nodes"))
    return materialize(members.where(~_fits_task(F.col("nodes"), F.col("edges"), limit)).select("component"), "level-large")


def _before_others(tagged: DataFrame) -> DataFrame:
    """Edges inside groups; the key is kept only where it comes before that of every pair that leaves the group."""
    rank = F.struct("k", "a", "b")
    leaving = tagged.where(F.col("k").isNotNull() & ~F.coalesce(F.col("ga") == F.col("gb"), F.lit(False)))
    ends = leaving.select(F.explode(F.array("ga", "gb")).alias("component"), rank.alias("r")).where("component IS NOT NULL")
    inside = _inside(tagged).join(ends.groupBy("component").agg(F.min("r").alias("bound")), "component", "left")
    first = F.col("bound").isNull() | (rank < F.col("bound"))
    return inside.withColumn("k", F.when(first, F.col("k"))).drop("bound")


def _one_level(edges: DataFrame, placed: DataFrame, cfg: DedupConfig, share: float) -> tuple[DataFrame, DataFrame, float]:
    """Edges and places after the merges inside groups that hang together by first choices, and the next share of a cut."""
    starters = edges.where(F.col("k").isNotNull())
    choices = materialize(_choices(starters), "level-choices")
    nodes = connected(choices)
    tagged = _tagged(edges, nodes)
    large = _too_large(tagged, nodes, cfg)
    all_bounded = is_empty(large)
    if not all_bounded:
        kept = nodes.join(large, "component", "left_anti").select("node", "component")
        cut = choices.join(nodes.join(large, "component", "left_semi").select(F.col("node").alias("a")), "a", "left_semi")
        nodes = kept.unionByName(connected(cut.where(F.col("k") <= _bound(cut, share))))
        tagged = _tagged(edges, nodes)
        large = _too_large(tagged, nodes, cfg)
        share = min(1.0, share * 2) if is_empty(large) else max(_LEAST_SHARE, share / 2)
    moves = _settled_moves(_before_others(tagged).join(large, "component", "left_anti"), edges.schema["a"].dataType)
    if not all_bounded:
        held = nodes.join(large, "component", "left_semi").select(F.col("node").alias("old"))
        moves = moves.unionByName(_agreed_moves(starters).join(held, "old", "left_semi"))
    return *_moved(edges, placed, materialize(moves, "moves")), share


def merge_levels(edges: DataFrame, placed: DataFrame, cfg: DedupConfig) -> tuple[DataFrame, int]:
    """``placed`` (cid, current, seq) after all merges along live ``edges``, and the number of levels taken.

    Before each level, what is left is looked at as a whole: components that a level may settle in one task are done, and only
    the larger ones go on.
    """
    id_type, share, levels = edges.schema["a"].dataType, 0.5, 0
    while True:
        starters = edges.where(F.col("k").isNotNull())
        if is_empty(starters):
            return placed, levels
        levels += 1
        nodes = connected(starters)
        tagged = _tagged(edges, nodes)
        large = _too_large(tagged, nodes, cfg)
        # Nothing outside a component can come before a pair inside.
        bounded = _inside(tagged).join(large, "component", "left_anti")
        placed = _replaced(placed, materialize(_settled_moves(bounded, id_type), "moves"))
        if is_empty(large):
            return placed, levels
        rest = materialize(_inside(tagged).join(large, "component", "left_semi").select(*EDGE_COLUMNS), "level-rest")
        edges, placed, share = _one_level(rest, placed, cfg, share)


def _from_points(family: Family, cfg: DedupConfig) -> tuple[DataFrame, DataFrame | None]:
    """Merges of the components that one task holds, and the clusters (a) of larger ones, if there are any."""
    nodes = connected(family.links)
    width = F.lit(0)
    if family.likeness.cosine is not None:
        width = F.greatest(F.size("vector"), width)
    limit = task_bytes(cfg)
    points = materialize(family.points.join(nodes, "node"), "family-points")
    sizes = points.groupBy("component").agg(F.count("*").alias("points"), F.max(width).alias("width"))
    large = sizes.where(~fits(F.col("points"), F.col("width"), limit)).select("component")
    if is_empty(large):
        return merge_families(points, family.places, family.likeness), None
    large = materialize(large, "large-families")
    merged = merge_families(points.join(large, "component", "left_anti"), family.places, family.likeness)
    return merged, materialize(points.join(large, "component", "left_semi").select(F.col("cid").alias("a")).distinct(), "large-clusters")


def complete_linkage(
    edges: DataFrame | Callable[[], DataFrame],
    cfg: DedupConfig = DedupConfig(),
    ordered: bool = False,
    all_initiate: bool = False,
    family: Family | None = None,
) -> DataFrame:
    """Merge clusters -> (cid, final, seq) for every cluster that an initiating pair touches.

    With a ``family`` the components that one task holds are merged from its points. ``edges`` may be a function, which
    is called if others remain.

    ``seq`` orders the clusters of a final group (in points). Member order only matters for groups above
    ``cfg.max_group_size`` files; for smaller ones it may be left at 0 unless ``ordered``.
    ``all_initiate`` tells that every edge has a key, so both of its ends share a component.
    """
    if family is not None and not hopeless(cfg.component_edge_limit * MAP_BYTES):
        merged, rest = _from_points(family, cfg)
        if rest is None:
            return materialize(merged, "linkage")
        others = (edges() if callable(edges) else edges).join(rest, "a", "left_semi")
        others = complete_linkage(others, cfg, ordered, all_initiate)
        return materialize(merged.unionByName(others.select("cid", "final", "seq")), "linkage")
    edges = edges() if callable(edges) else edges
    id_type = edges.schema["a"].dataType
    live = materialize(_live(edges), "linkage-live")
    nodes = connected(live.where(F.col("k").isNotNull()))
    if all_initiate:
        inside = live.join(nodes.select(F.col("node").alias("a"), "component"), "a")
    else:
        inside = _in_components(live, nodes)
    if live.count() <= cfg.component_edge_limit:
        return _merge_bounded(inside, id_type)
    nodes = materialize(nodes, "linkage-components")
    inside = materialize(inside, "linkage-inside")
    counts = inside.groupBy("component").agg(
        F.count("*").alias("edges"), F.sum(F.col("wa") + F.col("wb")).alias("ends")
    )
    counts = counts.join(nodes.groupBy("component").agg(F.count("*").alias("nodes")), "component")
    n, m = F.col("nodes"), F.col("edges")
    # In a complete graph every cluster ends n - 1 edges, so its files are counted n - 1 times.
    is_whole = m * 2 == n * (n - 1)
    if ordered:
        is_whole = F.lit(False)
    else:
        is_whole &= F.col("ends") <= cfg.max_group_size * (n - 1)
    kinds = counts.select(
        "component",
        F.when(is_whole, "whole").when(_fits_task(n, m, cfg.component_edge_limit), "bounded").otherwise("large").alias("kind"),
    )
    kinds = materialize(kinds, "linkage-kinds")
    whole = nodes.join(kinds.where("kind = 'whole'"), "component", "left_semi").select(
        F.col("node").alias("cid"), F.col("component").alias("final"), F.lit(0).cast("long").alias("seq")
    )
    bounded = inside.join(kinds.where("kind = 'bounded'"), "component", "left_semi")
    result = whole.unionByName(_merge_bounded(bounded, id_type))
    large = kinds.where("kind = 'large'")
    if is_empty(large):
        return materialize(result, "linkage")

    current = materialize(inside.join(large, "component", "left_semi").select(*EDGE_COLUMNS), "linkage-edges")
    placed = nodes.join(large, "component", "left_semi").select(
        F.col("node").alias("cid"), F.col("node").alias("current"), F.lit(0).cast("long").alias("seq")
    )
    placed, _ = merge_levels(current, placed, cfg)
    return materialize(result.unionByName(placed.withColumnRenamed("current", "final")), "linkage")
