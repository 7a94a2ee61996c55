"""Merging level by level against one ordered pass."""

import random

import pyarrow as pa
import pytest

from pixelkin.config import DedupConfig
from pixelkin.operators import linkage

EDGES = "a long, b long, na long, nb long, wa long, wb long, cnt long, k struct<dist:int,ha:long,hb:long>"


def one_pass(edges, weights):
    """{cluster: (final, seq)} by taking the edges in order."""
    links = {c: {} for c in weights}
    for a, b, *_ in edges:
        links[a][b] = links[b][a] = 1
    names = sorted(weights)
    at = {c: i for i, c in enumerate(names)}
    ordered = sorted((e for e in edges if e[7] is not None), key=lambda e: e[7])
    groups = linkage.greedy_merge(
        [at[e[0]] for e in ordered], [at[e[1]] for e in ordered],
        [{at[o]: n for o, n in links[c].items()} for c in names], [True] * len(ordered),
        [1] * len(names), [weights[c] for c in names],
    )
    return {names[m]: (names[g[0]], s) for g in groups for s, m in enumerate(g)}


def family(rng, nodes, density, levels):
    """A dense graph of similar pairs with ties in rank."""
    weights = {c: rng.randint(1, 4) for c in range(nodes)}
    edges = []
    for a in range(nodes):
        for b in range(a + 1, nodes):
            if rng.random() < density:
                starts = rng.random() < 0.9
                edges.append((a, b, 1, 1, weights[a], weights[b], 1, (rng.randrange(levels), a, b) if starts else None))
    return edges, weights


def merged(spark, edges, cfg):
    frame = spark.createDataFrame(edges, EDGES).repartition(4)
    nodes = sorted({c for e in edges for c in e[:2]})
    placed = spark.createDataFrame([(c, c, 0) for c in nodes], "cid long, current long, seq long")
    out, levels = linkage.merge_levels(frame, placed, cfg)
    return {r.cid: (r.current, r.seq) for r in out.collect()}, levels


@pytest.mark.parametrize("nodes,density,levels,limit,most", [(36, 0.7, 4, 100, 10)])
def test_levels_of_dense_families(spark, nodes, density, levels, limit, most):
    rng = random.Random(nodes)
    edges, weights = family(rng, nodes, density, levels)
    assert len(edges) > 4 * limit
    got, taken = merged(spark, edges, DedupConfig(component_edge_limit=limit))
    expected = one_pass(edges, {c: weights[c] for e in edges for c in e[:2]})
    assert got == expected
    assert len({g for g, _ in got.values()}) < len(got) and taken <= most


def test_levels_of_a_chain_in_order(spark):
    """Each pair waits for the one before it; levels take as much of the chain as one task may hold."""
    edges = [(i, i + 1, 1, 1, 1, 1, 1, (i, i, i + 1)) for i in range(60)]
    got, taken = merged(spark, edges, DedupConfig(component_edge_limit=30))
    assert got == one_pass(edges, {c: 1 for c in range(61)})
    assert taken <= 12


@pytest.mark.parametrize("group_edges,hubs,size", [(10**5, 4, 12), (6, 2, 7)])
def test_levels_of_hubs(spark, monkeypatch, group_edges, hubs, size):
    """The smallest name comes first at every distance, so that few pairs are the first choice of both sides."""
    monkeypatch.setattr(linkage, "_GROUP_EDGES", group_edges)
    rng, edges = random.Random(8), []
    for hub in range(0, hubs * size, size):
        for a in range(hub, hub + size):
            edges += [(a, b, 1, 1, 1, 1, 1, (rng.choice([1, 1, 2]), a, b)) for b in range(a + 1, hub + size) if rng.random() < 0.8]
    got, taken = merged(spark, edges, DedupConfig(component_edge_limit=2))
    assert got == one_pass(edges, {c: 1 for e in edges for c in e[:2]})
    assert taken <= 8


@pytest.mark.parametrize("share,rows,look", [(0, 7, (1, 8)), (64, 7, (1, 8)), (64, 64, (4, 16)), (64, 10**6, (256, 1 << 15))])
def test_edges_of_components_in_a_row(monkeypatch, share, rows, look):
    """Components that begin and end anywhere in a batch, in maps and in matrices."""
    monkeypatch.setattr(linkage, "_MATRIX_SHARE", share)
    monkeypatch.setattr(linkage, "_LOOK", look)
    rng, table, expected = random.Random(5), [], {}
    for component, nodes in enumerate([2, 40, 3, 2, 60, 25, 2]):
        edges, weights = family(rng, nodes, 0.8, 3)
        edges.sort(key=lambda e: (e[7] is not None, e[7] or (), e[:2]))
        expected |= {
            f"{component}-{m}": (f"{component}-{f}", s)
            for m, (f, s) in one_pass(edges, {c: weights[c] for e in edges for c in e[:2]}).items()
        }
        table += [(component, f"{component}-{e[0]}", f"{component}-{e[1]}", *e[2:7], e[7] is not None) for e in edges]
    names = ["component", "a", "b", "na", "nb", "wa", "wb", "cnt", "init"]
    batches = pa.table(dict(zip(names, map(list, zip(*table))))).to_batches(max_chunksize=rows)
    out = [r for batch in linkage._merge_kernel(batches) for r in batch.to_pylist()]
    assert {r["cid"]: (r["final"], r["seq"]) for r in out} == expected and len(out) == len(expected)


def test_dense_family_beyond_the_edge_limit_needs_no_levels(spark, monkeypatch):
    monkeypatch.setattr(linkage, "merge_levels", lambda *args: pytest.fail("merged level by level"))
    rng = random.Random(3)
    edges, weights = family(rng, 30, 0.7, 4)
    edges = [(*e[:7], e[7] or (9, *e[:2])) for e in edges]
    assert len(edges) > 200
    frame = spark.createDataFrame(edges, EDGES).repartition(3)
    out = linkage.complete_linkage(frame, DedupConfig(component_edge_limit=100), ordered=True, all_initiate=True)
    assert {r.cid: (r.final, r.seq) for r in out.collect()} == one_pass(edges, {c: weights[c] for e in edges for c in e[:2]})
