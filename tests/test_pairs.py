"""The Hamming join against all pairs."""

import random

import numpy as np
import pytest
from brute import popcount
from cases import signed

from pixelkin.operators import pairs, pivots, vectors


@pytest.fixture(scope="module")
def sample(spark):
    rng, found = random.Random(5), set()
    for _ in range(25):
        centre = rng.getrandbits(64)
        for _ in range(12):
            h = centre
            for _ in range(rng.randint(0, 9)):
                h ^= 1 << rng.randrange(64)
            found.add(h)
    # Many different hashes that share one band value.
    shared = pairs.bands_for(8, 3)[0].mask & (1 << 64) - 1
    for _ in range(80):
        found.add((0x123456789ABCDEF & shared) | (rng.getrandbits(64) & ~shared & 0xFFF00000FF))
    # The extreme bit pattern on its own and next to it.
    found |= {1 << 63, (1 << 63) | 1, 0, 1}
    hashes = sorted(signed(h) for h in found)
    frame = spark.createDataFrame([(h,) for h in hashes], "phash long").repartition(7)
    every = [(a, b, popcount(a, b)) for i, a in enumerate(hashes) for b in hashes[i + 1 :]]
    return frame, every


@pytest.mark.parametrize("threshold,m,hot", [(2, 3, 10**6), (4, 2, 40), (8, 3, 10**6), (8, 3, 40), (8, 5, 40), (12, 4, 10**6)])
def test_band_join(sample, threshold, m, hot):
    frame, every = sample
    got = [tuple(r) for r in pairs.band_hamming_pairs(frame, threshold, pairs.bands_for(threshold, m), hot).collect()]
    assert sorted(got) == sorted(p for p in every if p[2] <= threshold)


@pytest.mark.parametrize("threshold", [8, 20])
def test_block_join(sample, threshold, monkeypatch):
    frame, every = sample
    monkeypatch.setattr(pairs, "_BLOCK_ROWS", 50)
    got = [tuple(r) for r in pairs.grid_hamming_pairs(frame, threshold, len(every)).collect()]
    assert sorted(got) == sorted(p for p in every if p[2] <= threshold)


def test_copies_are_collapsed(spark):
    frame = spark.createDataFrame([(7,)] * 500 + [(6,)] * 3 + [(None,)], "phash long")
    assert [tuple(r) for r in pairs.hamming_pairs(frame, 2).collect()] == [(6, 7, 1)]


def test_layouts_cover_every_distance():
    for threshold in range(1, 14):
        for m in range(1, threshold + 2):
            bands = pairs.bands_for(threshold, m)
            assert sum(b.radius + 1 for b in bands) == threshold + 1
            assert sorted(bit for b in bands for bit in b.bits) == list(range(64))


def test_large_inputs_use_bands():
    assert pairs.choose_bands(8, 10**4) is None
    assert len(pairs.choose_bands(8, 10**7)) >= 2
    assert pairs.choose_bands(20, 10**9) is None


@pytest.mark.parametrize("threshold,block_rows", [(0, 16), (4, 16), (12, 40), (30, 4096)])
def test_pivot_join(sample, threshold, block_rows):
    frame, every = sample
    got = [tuple(r) for r in pairs.pivot_hamming_pairs(frame, threshold, frame.count(), block_rows).collect()]
    assert sorted(got) == sorted(p for p in every if p[2] <= threshold)


def test_clustered_hashes_are_not_compared_all_with_all(spark, monkeypatch):
    rng, found = random.Random(9), set()
    for _ in range(40):
        centre = rng.getrandbits(64)
        found |= {signed(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))) for _ in range(30)}
    frame = spark.createDataFrame([(h,) for h in found], "phash long").repartition(5)
    counts = pairs.hash_partition(frame, 6, len(found), 16).counts()
    assert counts["blocks"] >= 70 and counts["skipped"] > 0.9 * counts["block_pairs"]
    monkeypatch.setattr(pairs, "PIVOT_ROWS", 100)
    hashes = sorted(found)
    expected = sorted((a, b, popcount(a, b)) for i, a in enumerate(hashes) for b in hashes[i + 1 :] if popcount(a, b) <= 24)
    assert sorted(tuple(r) for r in pairs.hamming_pairs(frame, 24).collect()) == expected


def test_no_hashes_and_one(spark):
    none = spark.createDataFrame([], "phash long")
    assert pairs.pivot_hamming_pairs(spark.createDataFrame([(5,)], "phash long"), 3, 1).count() == 0
    assert pairs.hamming_pairs(none, 3).count() == 0


def directions(seed=3, clusters=12, size=25, width=96):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(clusters):
        centre = rng.normal(size=width)
        for _ in range(size):
            v = centre + rng.normal(size=width) * rng.choice([0.02, 0.15, 0.4])
            rows.append(v / np.linalg.norm(v) * rng.choice([1.0, 1.0, 0.97, 1.2]))
    rows += [np.zeros(width), rows[0], *[rng.normal(size=7) for _ in range(9)], np.array([])]
    return [(k, [float(x) for x in v]) for k, v in enumerate(rows)]


@pytest.mark.parametrize("threshold", [0.93, 0.4, 1.3, -0.05])
def test_cosine_pairs_by_angles(spark, monkeypatch, threshold):
    monkeypatch.setattr(vectors, "PIVOT_ROWS", 50)
    monkeypatch.setattr(vectors, "_BLOCK_BYTES", 16 * 96 * 8)
    rows = directions()
    frame = spark.createDataFrame(rows, "id long, vector array<double>").repartition(4)
    got = {(r.a, r.b): r.sim for r in vectors.cosine_pairs(frame, threshold).collect()}
    expected = {}
    for i, (a, x) in enumerate(rows):
        for b, y in rows[i + 1 :]:
            if x and len(x) == len(y) and (sim := round(float(np.dot(x, y)), 9)) >= threshold:
                expected[a, b] = sim
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k]) < 1e-8 for k in got)


def test_near_directions_only_meet_near_ones(spark):
    frame = spark.createDataFrame([r for r in directions() if len(r[1]) == 96], "id long, vector array<double>")
    counts = vectors.angle_partition(frame, 1.2, 302, 1.2, 16).counts()
    assert counts["skipped"] > 0.5 * counts["block_pairs"]


@pytest.mark.parametrize("threshold", [0.95, 0.2, -2.0])
def test_partial_products_lose_nothing(threshold):
    rng = np.random.default_rng(2)
    for width in (3, 64, 200):
        left, right = rng.normal(size=(90, width)), rng.normal(size=(70, width))
        right[:20] = left[:20] + rng.normal(size=(20, width)) * 0.1
        left, right = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (left, right))
        i, j, sims = vectors._close(left, right, threshold)
        full = left @ right.T
        assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(full >= threshold))))
        assert np.allclose(sims, full[i, j])


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_contents_of_blocks_are_not_shuffled_by_pairs(spark):
    rows = [r for r in directions() if len(r[1]) == 96]
    frame = spark.createDataFrame(rows, "id long, vector array<double>")
    found = vectors.pivot_cosine_pairs(frame, 0.93, len(rows), 1.2, 16)
    assert "CartesianProduct" in _plan(found) and "Exchange" not in _plan(found)
    hashes = spark.range(3000).selectExpr("xxhash64(id) AS phash")
    found = pairs.pivot_hamming_pairs(hashes, 12, 3000, 64)
    assert "CartesianProduct" in _plan(found) and "Exchange" not in _plan(found)
    every = [r.phash for r in hashes.collect()]
    near = sorted((a, b, popcount(a, b)) for i, a in enumerate(sorted(every)) for b in sorted(every)[i + 1 :] if popcount(a, b) <= 12)
    assert sorted(tuple(r) for r in found.collect()) == near


def test_comparisons_stay_in_bounded_pieces(monkeypatch):
    rng = np.random.default_rng(4)
    left, right = (rng.integers(-(2**63), 2**63 - 1, n) for n in (700, 9000))
    right[::70] = left[: len(right[::70])] ^ 3
    sizes = []
    real = np.bitwise_count
    monkeypatch.setattr(pairs.np, "bitwise_count", lambda x, **k: sizes.append(x.nbytes) or real(x, **k))
    got = {(int(a), int(b)) for p in pairs._compare(left, right, 12, True) for a, b in zip(p[0], p[1])}
    monkeypatch.undo()
    far = np.bitwise_count((left[:, None] ^ right[None, :]).view(np.uint64)) <= 12
    assert got == {(min(int(left[i]), int(right[j])), max(int(left[i]), int(right[j]))) for i, j in zip(*np.nonzero(far))}
    assert max(sizes) <= 1 << 20


def test_search_inside_a_task_by_band_values(monkeypatch):
    """Fewer pairs are compared than there are, none is lost or found twice, also where a band value is shared by many."""
    rng = np.random.default_rng(11)
    centres = rng.integers(0, 1 << 63, 60, dtype=np.uint64) << np.uint64(1)
    hashes = np.concatenate([rng.integers(0, 1 << 63, 3000, dtype=np.uint64), np.repeat(centres, 30)])
    for _ in range(7):
        hashes ^= np.uint64(1) << rng.integers(0, 64, len(hashes), dtype=np.uint64)
    hashes[:200] = rng.integers(0, 1 << 20, 200, dtype=np.uint64)
    hashes = rng.permutation(np.unique(hashes)).view(np.int64)
    left, right = hashes[:2000], hashes[2000:]
    monkeypatch.setattr(pairs, "_VALUE_COST", 0)
    monkeypatch.setattr(pairs, "_FOUND_ROWS", 50)
    dense, compared = pairs._dense, []

    def counted(a, b, threshold):
        compared.append(len(a) * len(b))
        return dense(a, b, threshold)

    monkeypatch.setattr(pairs, "_dense", counted)
    for threshold in (3, 8, 12, 17):
        for a, b, mirrored in ((left, right, True), (hashes, hashes, False)):
            compared.clear()
            got = [(x, y, d) for p in pairs._compare(a, b, threshold, mirrored) for x, y, d in zip(*(c.tolist() for c in p))]
            away = np.bitwise_count((a[:, None] ^ b[None, :]).view(np.uint64))
            i, j = np.nonzero(away <= threshold)
            want = {(min(x, y), max(x, y), d) for x, y, d in zip(a[i].tolist(), b[j].tolist(), away[i, j].tolist()) if x != y}
            assert set(got) == want and len(got) == len(want)
            assert sum(compared) < 0.7 * len(a) * len(b)


def test_bands_are_packed_and_bounded():
    assert pivots._first_bands([(0, 10), (1, 70), (2, 20), (5, 250), (7, 30)], 100, True) == (
        [(0, 0, 1), (1, 0, 1), (2, 0, 1), (5, 1, 3), (7, 4, 1)], 5
    )
    assert pivots._first_bands([(0, 10), (3, 250)], 100, False) == ([(0, 0, 1), (3, 1, 3)], 4)
    assert pivots._first_bands([], 100, True) == ([], 0)


def test_hashes_of_many_cells_meet_in_few_bands(sample):
    frame, every = sample
    partition = pairs.hash_partition(frame, 12, frame.count(), 16)
    cells = partition.blocks.select("cell").distinct().count()
    assert partition.bands.count() == 1 < cells
