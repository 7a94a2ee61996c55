"""N-gram Jaccard join and MinHash against comparisons of all pairs."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from llm_cases import DOCS, documents, frame, prose

from pixelkin.llm import arrow_text, minhash, ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingle_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def linked_rows(rows, percent=75):
    """(doc_id, set size, smallest id reached, links) of every row, by all pairs."""
    sets = [shingle_set(r[1]) for r in rows]
    label, links = list(range(len(rows))), [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if sets[a] and 100 * shared >= percent * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    names = {g: min((r[0] for r, x in zip(rows, label) if x == g and r[0] is not None), default=None) for g in set(label)}
    return Counter(
        (r[0], len(s), names[g] if n else r[0], n) for r, s, g, n in zip(rows, sets, label, links)
    )


def result(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "n_links").collect())


def test_what_shingles_cost_when_dealt(spark):
    # Beside its shingles a document sends little more than its name to a block, and 32 million letters make one block.
    rng = random.Random(11)
    docs = spark.createDataFrame([(k, prose(rng, rng.randint(100, 400))) for k in range(1500)], "doc_id long, text string").coalesce(1)
    rows = ngram_join._dealt(docs, 5, 64).collect()
    entries = sum(len(r.counts) // 2 for r in rows)
    packed = sum(len(pa.compress(bytes(x), codec="lz4", asbytes=True)) for r in rows for x in (r.refs, r.sizes, r.counts))
    assert packed < 11.6 * entries
    assert sum(len(r.low) for r in rows) == sum(len(shingle_set(r.text)) for r in docs.collect())
    assert ngram_join.BLOCK_CHARS >= 4 * ngram_join.HOME_CHARS


@pytest.mark.parametrize("kind", ["<u2", "<u4", "<i8"])
def test_numbers_by_the_place_of_their_bytes(kind):
    rng = np.random.default_rng(5)
    parts = [rng.integers(0, 1 << 15, n).astype(kind) * np.array(3, kind) for n in (0, 1, 70)]
    column = pa.chunked_array([pa.array([ngram_join._planes(x) for x in parts], pa.binary())])
    assert ngram_join._from_planes(column, kind).tolist() == np.concatenate(parts).tolist()
    assert len(ngram_join._from_planes(column.slice(0, 0), kind)) == 0


def test_blocks_sorted_in_parts(spark, monkeypatch):
    column = frame(spark, documents(8)).select("doc_id", "text").coalesce(1)
    tables = []
    for most in (1_500_000, 40):
        monkeypatch.setattr(ngram_join, "PART_SHINGLES", most)
        dealt = pa.Table.from_pylist([r.asDict() for r in ngram_join._dealt(column, 5, 1).collect()])
        found = ngram_join._shared(3)((pa.scalar(0),), dealt)
        profile = pa.concat_tables([ngram_join._profiled(75)((pa.scalar(h),), found.filter(pa.compute.equal(found["home"], h))) for h in range(3)])
        tables.append(profile.sort_by("ref").to_pylist())
    assert tables[0] == tables[1] and tables[0]


def test_words_and_shingles_of_a_column():
    texts = [None, "", "a", "A b\tc\x0bd e f", "é b", "x" * 70 + " y" * 9, " lead", "trail "]
    data, offsets = arrow_text.utf8(pa.array(texts))
    hashes, edges = arrow_text.words(data, offsets)
    expected = [WORD.findall((t or "").translate(LOWER)) for t in texts]
    assert np.diff(edges).tolist() == [len(w) for w in expected]
    flat = [w for words in expected for w in words]
    assert len(set(hashes.tolist())) == len(set(flat))
    assert {(w, h) for w, h in zip(flat, hashes.tolist())} == dict(zip(flat, hashes.tolist())).items()
    assert [len(s) for s in arrow_text.shingles(data, offsets)] == [max(len(w) - 4, 1 if w else 0) for w in expected]


def test_slices_do_not_change_words(monkeypatch):
    rng = random.Random(4)
    texts = [prose(rng, rng.choice([0, 3, 900])) for _ in range(20)] + ["y" * 5000]
    data, offsets = arrow_text.utf8(pa.array(texts))
    whole = arrow_text.words(data, offsets)
    monkeypatch.setattr(arrow_text, "SLICE_BYTES", 64)
    small = arrow_text.words(data, offsets)
    assert (whole[0] == small[0]).all() and (whole[1] == small[1]).all()
    assert list(arrow_text.slices(np.array([0, 5, 5, 200, 210]), 64)) == [(0, 2), (2, 3), (3, 4)]


@pytest.mark.parametrize("seed", [1, 2])
def test_join_finds_every_link(spark, seed):
    rows = documents(seed, families=14)
    assert result(ngram_join.jaccard_join(frame(spark, rows))) == linked_rows(rows)


def test_join_in_small_blocks(spark, monkeypatch):
    """A family of near copies that spans many blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 4)
    rng = random.Random(8)
    base = prose(rng, 60).split(" ")
    rows = []
    for k in range(30):
        own = list(base)
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(40)}"
        rows.append((k, " ".join(own), *[None] * 7))
    assert result(ngram_join.jaccard_join(frame(spark, rows))) == linked_rows(rows)


def test_class_numbers_beyond_24_bits():
    top = 1 << 24
    token = np.array([5, 5, 4, 5, 5, (1 << 40) - 1], np.uint64)
    owner = np.array([top + 1, 1, top, 1, top + 1, top + 7])
    pairs = list(zip(*(x.tolist() for x in ngram_join._distinct(token, owner, top + 8))))
    assert pairs == [(4, top), (5, 1), (5, top + 1), ((1 << 40) - 1, top + 7)]
    few = owner % 7
    packed, wide = ngram_join._distinct(token, few, 7), ngram_join._distinct(token, few, 7, packed=0)
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(packed, wide))


def test_join_of_nothing(spark):
    assert ngram_join.jaccard_join(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(1, None, *[None] * 7), (1, None, *[None] * 7), (2, " ", *[None] * 7)]
    assert result(ngram_join.jaccard_join(frame(spark, rows))) == linked_rows(rows)


def test_sets_on_the_threshold(spark):
    words = [f"w{k}" for k in range(200)]
    rows = []
    for k, cut in enumerate((0, 12, 13, 14, 27, 28, 29)):
        rows.append((k, " ".join(words[cut : 100 + cut]), *[None] * 7))
    assert result(ngram_join.jaccard_join(frame(spark, rows))) == linked_rows(rows)


def near(a, b):
    return float((minhash.signature(a) == minhash.signature(b)).mean())


def test_signature_estimates_likeness():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for shared in (0, 1000, 2000, 2700):
        y = np.concatenate([x[:shared], rng.integers(0, 1 << 63, 3000 - shared, dtype=np.uint64)])
        assert abs(near(x, y) - shared / (6000 - shared)) < 0.15
    assert near(x, x[::-1].copy()) == 1 and near(x, x[:0]) == 0 and near(x[:0], x[:0]) == 1


def test_fingerprints_follow_the_ids(spark):
    rows = [r for r in documents(5) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    got = {r.doc_id: r for r in minhash.fingerprinted(frame(spark, rows)).collect()}
    order = sorted(rows)
    assert len(got) == len(rows)
    prints = {}
    for k, r in enumerate(order):
        text, following = r[1] or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own = got[r[0]]
        assert own.n_chars == len(text) and own.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, own.fingerprint) == own.fingerprint
        a, b, c = (next(iter(minhash.signatures(pa.array([t])))) for t in (text, edited, following))
        assert own.near_edited == (a == b).mean() and own.near_next == (a == c).mean()


def test_fingerprints_of_odd_tables(spark):
    assert minhash.fingerprinted(spark.createDataFrame([], DOCS)).count() == 0
    one = minhash.fingerprinted(frame(spark, [(7, "a b c d e f", *[None] * 7)])).first()
    assert one.near_next == 1
    assert minhash.fingerprinted(frame(spark)).count() == len(documents())


def test_near_duplicates_are_verified(spark):
    rows = documents(6, families=10)
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in minhash.near_duplicates(frame(spark, rows)).collect())
    assert got == Counter((d, c, n) for (d, _, c, n), k in linked_rows(rows).items() for _ in range(k))


def test_near_duplicates_without_ids_of_their_own(spark):
    words = [f"w{k}" for k in range(80)]
    first, second = [" ".join([*words[:-1], end]) for end in ("x", "y")]
    third, fourth = [" ".join([*words[:0:-1], end]) for end in ("x", "y")]
    rows = [(None, first), (None, second), (4, third), (4, " ".join(words[::2])), (4, " ".join(words[::3])), (9, fourth)]
    got = Counter(map(tuple, minhash.near_duplicates(frame(spark, [(*r, *[None] * 7) for r in rows])).collect()))
    assert got == Counter({(None, None, 1): 2, (4, 4, 1): 1, (4, 4, 0): 2, (9, 4, 1): 1})
