"""Connected components of a pair table by star contraction.

Every step is a map-side combined minimum and a join, so a hub with many neighbours is never gathered.
The loop ends when the edges form stars around the smallest node of each component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelkin.session import is_empty, materialize

# Pairs that a task holds before it reduces them to the links that they need.
_HELD_PAIRS = 1 << 20
# Links of a forest that one task finishes, of numbers and of texts.
_TASK_LINKS = {True: 1 << 22, False: 1 << 20}


def _downward(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("m"))
    linked = both.join(lowest, "u").where(F.col("v") > F.col("u"))
    return _downward(linked.select("v", F.least("u", "m").alias("m")).toDF("u", "v"))


def _small_star(edges: DataFrame) -> DataFrame:
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(lowest, "u").where(F.col("v") != F.col("m")).select("v", "m").toDF("u", "v")
    return _downward(moved.unionByName(lowest.toDF("u", "v")))


def _are_stars(edges: DataFrame) -> bool:
    """Every node points at most once, and none that points is pointed at."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("u").alias("n"), F.lit(1).alias("out")),
                F.struct(F.col("v").alias("n"), F.lit(0).alias("out")),
            )
        ).alias("e")
    ).select("e.*")
    seen = ends.groupBy("n").agg(F.sum("out").alias("outs"), F.min("out").alias("least"))
    return is_empty(seen.where((F.col("outs") > 1) | ((F.col("outs") == 1) & (F.col("least") == 0))))


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``pairs``; a component is named by its smallest node."""
    edges = _downward(pairs.select(F.col(a).alias("u"), F.col(b).alias("v")))
    while True:
        edges = materialize(_small_star(_large_star(edges)), "stars")
        if _are_stars(edges):
            break
    centres = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.toDF("node", "component").unionByName(centres)


def local_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` numbers the least that the pairs (a, b) connect it with."""
    labels = np.arange(n)
    while len(a):
        a, b = labels[a], labels[b]
        low, high = np.minimum(a, b), np.maximum(a, b)
        apart = low != high
        a, b = low[apart], high[apart]
        np.minimum.at(labels, b, a)
        while True:
            further = labels[labels]
            if (further == labels).all():
                break
            labels = further
    return labels


def _linked(sides: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
    """The names of both sides in order, and the place of the least that each is connected with."""
    both = pa.chunked_array(sides).combine_chunks().dictionary_encode()
    order = pc.sort_indices(both.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    a, b = np.split(place[both.indices.to_numpy()], 2)
    return both.dictionary.take(pa.array(order)), local_labels(a, b, len(order))


def _forest_kernel(batches):
    """Pairs (a, b) -> as few that connect the same, (node, least node of what hangs together here)."""
    held, rows = [[], []], 0

    def reduced():
        names, labels = _linked([*held[0], *held[1]])
        own = np.flatnonzero(labels != np.arange(len(labels)))
        return names.take(pa.array(own)), names.take(pa.array(labels[own]))

    limit = _HELD_PAIRS
    for batch in batches:
        held[0].append(batch.column(0))
        held[1].append(batch.column(1))
        rows += batch.num_rows
        if rows >= limit:
            a, b = reduced()
            # What cannot be reduced further must not be tried again with every batch.
            held, rows, limit = [[a], [b]], len(a), max(_HELD_PAIRS, 2 * len(a))
    if rows:
        a, b = reduced()
        if len(a):
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])


def _stars_kernel(batches):
    """All links of a forest -> (node, component)."""
    sides = [[], []]
    for batch in batches:
        sides[0].append(batch.column(0))
        sides[1].append(batch.column(1))
    if sides[0]:
        names, labels = _linked([*sides[0], *sides[1]])
        yield pa.RecordBatch.from_arrays([names, names.take(pa.array(labels))], ["node", "component"])


def connected(pairs: DataFrame) -> DataFrame:
    """What ``components`` gives for pairs (a, b) of numbers or texts, when there are many more pairs than nodes.

    Each task first reduces its pairs to a forest, so pairs are read once and never shuffled. A forest of bounded size is
    finished in one task; a larger one goes on by star contraction.
    """
    kind = pairs.schema["a"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    pairs = pairs.where(F.col("a") != F.col("b")).select("a", "b")
    forest = materialize(pairs.mapInArrow(_forest_kernel, schema), "forest")
    if forest.count() > _TASK_LINKS[isinstance(kind, T.LongType)]:
        return components(forest)
    schema = T.StructType([T.StructField("node", kind), T.StructField("component", kind)])
    return materialize(forest.repartition(1).mapInArrow(_stars_kernel, schema), "components")
