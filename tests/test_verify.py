"""In-group verification, with and without the screening of large groups."""

import random

import numpy as np
import pyarrow as pa
import pytest
from brute import dots, popcount
from cases import signed, unit

from pixelkin.operators import vectors
from pixelkin.operators.vectors import hash_evictions, vector_evictions


@pytest.mark.parametrize("chunk_rows", [512, 6])
@pytest.mark.parametrize("spread", [0.05, 0.2])
def test_vector_evictions(spark, chunk_rows, spread):
    rng = random.Random(11)
    rows = []
    for g in range(4):
        centre = [rng.gauss(0, 1) for _ in range(5)]
        for m in range(rng.choice([1, 5, 25])):
            vec = None if rng.random() < 0.1 else unit([x + rng.gauss(0, spread) for x in centre])
            rows.append((g, f"{g}-{m}", vec, rng.choice([1, 1, 2])))
    df = spark.createDataFrame(rows, "grp int, id string, vector array<double>, w long")
    expected = set()
    for g, name, vec, w in rows:
        peers = [r for r in rows if r[0] == g and r[2] is not None and (r[1] != name or w > 1)]
        if vec is None or (peers and min(dots(vec, p[2]) for p in peers) < 0.93):
            expected.add(name)
    assert {r.id for r in vector_evictions(df, 0.93, chunk_rows).collect()} == expected


def test_a_vector_of_no_length_fits_nothing(spark):
    rows = [(1, "a", [0.0, 0.0], 2), (2, "b", [0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "grp int, id string, vector array<double>, w long")
    assert {r.id for r in vector_evictions(df, 0.93, 8).collect()} == {"a"}


@pytest.mark.parametrize("chunk_rows", [512, 5])
def test_hash_evictions(spark, chunk_rows):
    rng = random.Random(5)
    rows = []
    for g in range(4):
        centre = rng.getrandbits(64)
        for m in range(20):
            h = centre
            for _ in range(rng.choice([0, 1, 3, 9])):
                h ^= 1 << rng.randrange(64)
            rows.append((g, f"{g}-{m}", signed(h), 1))
    df = spark.createDataFrame(rows, "grp int, id string, phash long, w long")
    expected = {
        a[1] for a in rows if max(popcount(a[2], b[2]) for b in rows if b[0] == a[0] and b[1] != a[1]) > 12
    }
    assert {r.id for r in hash_evictions(df, 12, chunk_rows).collect()} == expected


def test_flat_pairs_are_those_of_every_row():
    lo, ro = np.array([0, 2, 5, 6]), np.array([0, 3, 4, 4 + 2])
    i, j, left, first = vectors._flat(lo, ro, np.array([0, 2]))
    assert list(zip(i.tolist(), j.tolist())) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (5, 4), (5, 5)]
    assert left.tolist() == [0, 1, 5] and first.tolist() == [0, 3, 6]


def test_a_batch_of_single_links_is_one_product(monkeypatch):
    calls = []
    real = np.einsum
    monkeypatch.setattr(vectors.np, "einsum", lambda *a: calls.append(1) or real(*a))
    rng = np.random.default_rng(0)
    values = [rng.normal(size=8).tolist() if k % 10 else rng.normal(size=3).tolist() for k in range(400)]
    column = pa.array(values, pa.list_(pa.float32()))
    i, j = np.arange(400), rng.permutation(400)
    got = vectors._pair_dots(column, column, i, j)
    exact = [np.dot(np.float32(values[a]).astype(float), np.float32(values[b]).astype(float)) if len(values[a]) == len(values[b]) else 0.0 for a, b in zip(i, j)]
    assert np.allclose(got, exact) and len(calls) == 2


@pytest.mark.parametrize("flat", [0, 10, 10**6])
def test_flat_and_whole_products_agree(spark, monkeypatch, flat):
    monkeypatch.setattr(vectors, "_FLAT_PAIRS", flat)
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(0, 9)), k, unit((rng.normal(size=rng.choice([4, 4, 6])) * 0.4 + 1.5).tolist()), int(rng.integers(1, 3))) for k in range(120)]
    df = spark.createDataFrame(rows, "grp int, id long, vector array<double>, w long")
    gone = {r.id for r in vector_evictions(df, 0.93, 8).collect()}
    expected = {
        a[1] for a in rows
        if any((a[1] != b[1] or a[3] > 1) and a[0] == b[0] and round(dots(a[2], b[2]), 9) < 0.93 for b in rows)
        and any((a[1] != b[1] or a[3] > 1) and a[0] == b[0] for b in rows)
    }
    assert gone == expected
