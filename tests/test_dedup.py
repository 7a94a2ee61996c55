"""The pipelines against one sequential pass over all file pairs."""

import random

import brute
import pytest
from cases import SCHEMA, groups_of, random_rows, signed, unit

from pixelkin.config import DedupConfig
from pixelkin.plans.dedup import dedup


def check(spark, rows, mode, cfg=DedupConfig(), parts=5):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    run = dedup(df, df.select("file_id", "vector"), mode, cfg)
    groups, suspects, confirmed = brute.run(rows, mode, cfg.phash_threshold, cfg.cosine_threshold, cfg.max_group_size)
    assert groups_of(run) == groups
    summary = run.summary.first()
    assert (summary.suspect_pairs_checked, summary.ai_confirmed) == (suspects, confirmed)
    assert summary.groups_found == len(groups)
    assert summary.total_duplicates == sum(map(len, groups))
    return run


@pytest.mark.parametrize("mode", ["phash", "phash_ai", "ai"])
@pytest.mark.parametrize("seed,mixed", [(3, False), (4, True)])
def test_random_families(spark, mode, seed, mixed):
    check(spark, random_rows(seed, mixed=mixed), mode)


@pytest.mark.parametrize("mode,mixed", [("phash", True), ("phash_ai", False)])
def test_distributed_rounds(spark, mode, mixed):
    """Tiny limits force every fallback for data that one task should not hold."""
    cfg = DedupConfig(component_edge_limit=3, chunk_rows=5, split_point_limit=6)
    check(spark, random_rows(7, families=6, mixed=mixed), mode, cfg)


def row(name, phash, md5=None, vector=(1.0, 0.0)):
    return (name, f"/t/{name}.jpg", signed(phash), md5, None if vector is None else list(vector))


def bits(*positions):
    return sum(1 << p for p in positions)


def test_chain_is_not_one_group(spark):
    rows = [row("a", 0), row("b", bits(0, 1, 2, 3, 4)), row("c", bits(*range(10)))]
    assert groups_of(check(spark, rows, "phash")) == {frozenset("ab")}


def test_twins_are_parted_by_an_outlier(spark):
    """Equal content is one group until a member far away by vector makes everyone fail."""
    rows = [row("a", 0, "m"), row("b", 0, "m"), row("c", 1, None, (0.0, 1.0))]
    assert groups_of(check(spark, rows, "phash_ai")) == set()
    assert groups_of(check(spark, rows, "phash")) == {frozenset("abc")}


def test_members_without_vector(spark):
    rows = [row("a", 0, "m"), row("b", 0, "m", None), row("c", 1)]
    assert groups_of(check(spark, rows, "phash_ai")) == {frozenset("ac")}
    assert groups_of(check(spark, rows, "ai")) == {frozenset("ab")}


def test_files_without_hash_never_take_part(spark):
    rows = [row("a", 0, "m"), row("b", 0, "m"), ("v", "/t/v.mp4", None, "m", None)]
    assert groups_of(check(spark, rows, "phash")) == {frozenset("ab")}


def test_oversized_group_is_split(spark):
    rng, rows = random.Random(2), []
    for i in range(25):
        h = bits(*rng.sample(range(8), rng.randint(0, 4)))
        angle = rng.uniform(0, 0.36)
        rows.append((f"f{i:02}", f"/t/f{i:02}.jpg", h, None, unit([1.0, angle])))
    for mode in ("phash", "ai"):
        run = check(spark, rows, mode)
        assert run.summary.first().groups_found > 1


def test_a_family_of_copies_is_one_point(spark):
    rows = [row(f"c{i:03}", 5, "same") for i in range(300)] + [row("x", 4), row("y", ((1 << 20) - 1) << 30)]
    run = check(spark, rows, "phash_ai")
    assert max(map(len, groups_of(run))) == 301


def test_path_keys_target_and_modes(spark):
    rows = [
        ("a", "/lib/A.jpg", 0, None, [1.0, 0.0]),
        ("b", "/LIB/a.jpg", 0, None, [1.0, 0.0]),
        ("c", "/lib2/c.jpg", 0, None, [1.0, 0.0]),
        ("d", "/other/d.jpg", 0, None, [1.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    run = dedup(df, None, "whatever", target_dir="/lib")
    assert run.summary.first().total_target_images == 2
    assert run.summary.first().methods == ["pHash"]
    assert len(groups_of(run)) == 1
    with pytest.raises(ValueError):
        dedup(df, None, "ai")
    nothing = dedup(df.where("false"), None, "phash").summary.first()
    assert (nothing.total_target_images, nothing.groups_found, nothing.methods) == (0, 0, [])


def test_partitioning_does_not_matter(spark):
    rows = random_rows(9, families=5)
    df = spark.createDataFrame(rows, SCHEMA)
    results = [groups_of(dedup(df.repartition(n), df.select("file_id", "vector"))) for n in (1, 6)]
    assert results[0] == results[1]
