"""Components merged from their points against one ordered pass, and forests against star contraction."""

import numpy as np
import pyarrow as pa
import pytest
from cases import signed
from pyspark.sql import functions as F

from pixelkin.operators import families
from pixelkin.operators.components import components, connected
from pixelkin.operators.families import BITS, COSINE, PLACE, Likeness

KINDS = [Likeness(BITS, bits=6), Likeness(COSINE, cosine=0.93), Likeness(PLACE, bits=9, cosine=0.9, above=5)]
MERGED = pa.schema([("cid", pa.string()), ("final", pa.string()), ("seq", pa.int64())])


def points(seed, shared, like, sizes=(2, 40, 3, 70)):
    """Rows of components with near hashes and vectors; ``shared`` puts several points into a cluster."""
    rng, rows = np.random.default_rng(seed), []
    for component, n in enumerate(sizes):
        base, direction = int(rng.integers(1 << 62)), rng.normal(size=8)
        for i in range(n):
            h = base
            for _ in range(rng.integers(0, 6)):
                h ^= 1 << int(rng.integers(64))
            vector = direction + rng.normal(size=8) * 0.18
            rows.append(
                {
                    "component": component, "cid": f"{component}-{i // 2 if shared else i}", "w": int(rng.integers(1, 4)),
                    "phash": signed(h), "vector": (vector / np.linalg.norm(vector)).tolist(), "unit": f"{component}-{i // 3}",
                }
            )
    keep = ["component", "cid", "w"] + (["phash"] if like.bits is not None else []) + (["vector"] if like.cosine is not None else [])
    return [{k: r[k] for k in keep + (["unit"] if like.order == PLACE else [])} for r in rows]


def judged(rows, like):
    """(similar, may start, rank) of two rows."""
    near, rank = {}, {}
    for i, x in enumerate(rows):
        for j, y in enumerate(rows):
            bits = ((x.get("phash", 0) ^ y.get("phash", 0)) & (1 << 64) - 1).bit_count()
            sim = round(float(np.dot(x.get("vector", [1]), y.get("vector", [1]))), 9)
            near[i, j] = x["component"] == y["component"] and (like.bits is None or bits <= like.bits) and (like.cosine is None or sim >= like.cosine)
            if i < j and near[i, j] and bits > like.above and (like.order != PLACE or x["unit"] != y["unit"]):
                rank[i, j] = ({BITS: bits, COSINE: -sim, PLACE: 0}[like.order], i, j)
    return near, sorted(rank, key=rank.get)


def one_pass(rows, like):
    near, order = judged(rows, like)
    groups, at, weight = {}, {}, {}
    for i, r in enumerate(rows):
        groups[r["cid"]] = [r["cid"]]
        at.setdefault(r["cid"], []).append(i)
        weight[r["cid"]] = weight.get(r["cid"], 0) + r["w"]
    home, own = {c: c for c in groups}, {c: len(x) for c, x in at.items()}
    for i, j in order:
        a, b = home[rows[i]["cid"]], home[rows[j]["cid"]]
        if a == b or not all(near[x, y] for x in at[a] for y in at[b]):
            continue
        keep, gone = (b, a) if weight[a] <= weight[b] else (a, b)
        home |= {c: keep for c in groups[gone]}
        groups[keep] += groups.pop(gone)
        at[keep] += at.pop(gone)
        weight[keep] += weight[gone]
    out = {}
    for group in groups.values():
        before = 0
        for c in group:
            out[c] = (group[0], before)
            before += own[c]
    return out


@pytest.mark.parametrize("like", KINDS, ids=lambda x: x.order)
@pytest.mark.parametrize("shared", [False, True])
@pytest.mark.parametrize("small,ordered,block,batch", [(10**6, 1 << 22, 1 << 21, 10**6), (0, 7, 256, 13), (50, 1 << 22, 1 << 21, 17)])
def test_points_against_one_pass(monkeypatch, like, shared, small, ordered, block, batch):
    monkeypatch.setattr(families, "_SMALL", small)
    monkeypatch.setattr(families, "_ORDERED_PAIRS", ordered)
    monkeypatch.setattr(families, "_BLOCK_VALUES", block)
    rows = points(5, shared, like)
    batches = pa.Table.from_pylist(rows).to_batches(max_chunksize=batch)
    found = [r for out in families._by_component(families._merge_rows, like, MERGED)(batches) for r in out.to_pylist()]
    assert len(found) == len({r["cid"] for r in rows})
    assert {r["cid"]: (r["final"], r["seq"]) for r in found} == one_pass(rows, like)


@pytest.mark.parametrize("small", [0, 64])
def test_start_links_connect_what_pairs_connect(monkeypatch, small):
    monkeypatch.setattr(families, "_SMALL", small)
    like, rows = KINDS[2], points(6, False, KINDS[2], (40, 2, 2, 70))
    schema = pa.schema([("a", pa.string()), ("b", pa.string())])
    outs = list(families._by_component(families._link_rows, like, schema)(pa.Table.from_pylist(rows).to_batches()))
    # An empty batch would end the stream.
    assert all(out.num_rows for out in outs)
    names = sorted({r["cid"] for r in rows})
    at = {c: i for i, c in enumerate(names)}

    def parted(pairs):
        labels = families.local_labels(np.array([at[a] for a, _ in pairs]), np.array([at[b] for _, b in pairs]), len(names))
        return labels.tolist()

    links = [(r["a"], r["b"]) for out in outs for r in out.to_pylist()]
    assert parted(links) == parted([(rows[i]["cid"], rows[j]["cid"]) for i, j in judged(rows, like)[1]])
    assert len(links) < len(names)


def test_unequal_widths_are_not_similar():
    rows = [{"component": 1, "cid": c, "w": 1, "vector": v} for c, v in (("a", [1.0]), ("b", [1.0, 0.0]), ("c", [1.0, 0.0]))]
    found = list(families._by_component(families._merge_rows, Likeness(COSINE, cosine=0.9), MERGED)(pa.Table.from_pylist(rows).to_batches()))
    assert sorted(r["final"] for out in found for r in out.to_pylist()) == ["a", "c", "c"]


def test_components_stay_whole_after_a_join(spark):
    """Every component is in one task, also where a join on it came before and became a broadcast."""
    conf = {"autoBroadcastJoinThreshold": "-1", "adaptive.autoBroadcastJoinThreshold": "10m", "adaptive.coalescePartitions.enabled": "false"}
    for key, value in conf.items():
        spark.conf.set(f"spark.sql.{key}", value)
    try:
        rows = spark.range(6000).selectExpr("id % 300 AS component", "id").repartition(7)
        few = rows.groupBy("component").count().where("count > 1").select("component")
        dealt = families.whole_components(rows.join(few, "component", "left_semi"))

        def seen(batches):
            names = {x for b in batches for x in b.column("component").to_pylist()}
            yield pa.RecordBatch.from_pydict({"component": pa.array(sorted(names), pa.int64())})

        assert dealt.mapInArrow(seen, "component long").groupBy("component").count().agg(F.max("count")).first()[0] == 1
    finally:
        for key in conf:
            spark.conf.unset(f"spark.sql.{key}")


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("links", [10**6, 0])
def test_forests_against_stars(spark, monkeypatch, kind, links):
    from pixelkin.operators import components as module

    monkeypatch.setattr(module, "_TASK_LINKS", {True: links, False: links})
    monkeypatch.setattr(module, "_HELD_PAIRS", 5)
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(None, 3)]
    frame = spark.createDataFrame(pairs, "a long, b long").select(F.col("a").cast(kind), F.col("b").cast(kind)).repartition(3)
    assert sorted(map(tuple, connected(frame).collect())) == sorted(map(tuple, components(frame).collect()))
