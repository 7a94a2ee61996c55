"""Ordinals, components, splitting, skewed lookups, review, organizing, expressions."""

import random
from collections import Counter
from pathlib import Path

import pytest
from brute import popcount
from pyspark.sql import functions as F

from pixelkin.functions import dates, fingerprints, paths
from pixelkin.operators import catalog, components, ordinals, review, skew, split
from pixelkin.plans import organize
from pixelkin.session import scratch_dir


def test_ordinals(spark):
    df = spark.range(500).selectExpr("id", "id % 3 AS g", "(id * 7919) % 500 AS v")
    assert sorted((r.v, r.o) for r in ordinals.with_ordinal(df, ["v"], "o").collect()) == [(i, i) for i in range(500)]
    per_group: dict = {}
    for r in ordinals.with_group_ordinal(df, ["g"], ["v"], "o").collect():
        per_group.setdefault(r.g, []).append((r.v, r.o))
    assert all([o for _, o in sorted(x)] == list(range(len(x))) for x in per_group.values())


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 130)]
    pairs += [tuple(rng.sample(range(200, 260), 2)) for _ in range(40)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(map(tuple, components.components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {x: find(x) for x in parent}


def test_keyed_join_with_hot_keys(spark):
    rows = spark.range(300).selectExpr("id", "CASE WHEN id < 100 THEN 'hot' ELSE concat('k', id % 50) END AS k")
    facts = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    plain = sorted(map(tuple, rows.join(facts, "k").select("id", "k", "n", "low").collect()))
    assert sorted(map(tuple, skew.keyed_join(rows, facts, "k", "n", 20).select("id", "k", "n", "low").collect())) == plain


@pytest.mark.parametrize("point_limit", [1000, 9])
def test_first_fit(spark, point_limit):
    rng, rows = random.Random(3), []
    for g in range(2):
        centre = rng.getrandbits(63)
        for p in range(30):
            h = centre
            for _ in range(rng.randint(0, 4)):
                h ^= 1 << rng.randrange(63)
            rows.append((g, p, f"{g}-{p:02}", h))
    expected: dict = {}
    for g in range(2):
        parts: list = []
        for _, _, name, h in (r for r in rows if r[0] == g):
            home = next((k for k, part in enumerate(parts) if all(popcount(h, o) <= 4 for o in part)), None)
            if home is None:
                home = len(parts)
                parts.append([])
            parts[home].append(h)
            expected[name] = home
    df = spark.createDataFrame(rows, "grp int, pos int, id string, value long").repartition(3)
    got = {r.id: r.part for r in split.split_by_first_fit(df, "hamming", 4, point_limit, 4).collect()}
    assert got == expected


def test_batches_of_a_split_are_written_once(spark):
    rng = random.Random(8)
    rows = [("g", k, f"{k:03}", rng.getrandbits(40)) for k in range(90)]
    written = lambda tag: set(Path(scratch_dir(spark).removeprefix("file:")).glob(f"{tag}-*/*"))
    before = {tag: written(tag) for tag in ("split-placed", "split-tallies")}
    df = spark.createDataFrame(rows, "grp string, pos int, id string, value long")
    parts = split.split_by_first_fit(df, "hamming", 12, 10, 4)
    got = {r.id: r.part for r in parts.collect()}
    placed, tallies = (sorted(written(tag) - before[tag]) for tag in ("split-placed", "split-tallies"))
    assert len(placed) == len(tallies) == 9
    rounds = [spark.read.parquet(str(p)).count() for p in placed]
    assert rounds == [10] * 9 and len(got) == 90
    # Tallies of all rounds add up to the parts.
    sizes = Counter()
    for r in spark.read.parquet(*map(str, tallies)).collect():
        sizes[r.part] += r.size
    assert sizes == Counter(got.values())


def test_placed_values_are_packed_once(spark, monkeypatch):
    """Each batch is packed as the one to place and as what is placed; the values of earlier batches are not packed again."""
    packed, chunked = [], split.chunked
    monkeypatch.setattr(split, "chunked", lambda df, *rest: packed.append(df.count()) or chunked(df, *rest))
    rows = [(1, k, str(k), (k * 0x9E3779B97F4A7C15) % (1 << 63)) for k in range(60)]
    df = spark.createDataFrame(rows, "grp int, pos int, id string, value long")
    assert split.split_by_first_fit(df, "hamming", 12, 10, 4).count() == 60
    assert max(packed) == 10 and sum(packed) == 100


def values(spark, rows, schema, **columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_path_expressions(spark):
    rows = [("/a/B.JPG",), ("/a/.jpg",), ("/a/x.tar.gz",), ("/a.b/none",), ("C:\\x\\y.JPG",), ("/a/song.M4A",), ("/a/v.webm",)]
    got = values(spark, rows, "p string", t=paths.classify_extension(F.col("p")), n=paths.file_name(F.col("p")))
    assert [g[0] for g in got] == ["image", None, None, None, "image", "audio", "video"]
    assert [g[1] for g in got[:4]] == ["B.JPG", ".jpg", "x.tar.gz", "none"]
    rows = [("/t/a/x.jpg",), ("/t/x.jpg",), ("/o/x.jpg",), ("\\t\\a\\x.jpg",), ("x.jpg",), ("/t2/x.jpg",)]
    folders = [v[0] for v in values(spark, rows, "p string", f=paths.relative_folder(F.col("p"), "/t/"))]
    assert folders == ["a", "/", "/o", "a", "", "2"]
    rows = [("/a/b/x",), ("/a/b2/x",), ("/A/B/x",), ("\\a\\b\\x",)]
    path = F.col("p")
    got = values(
        spark, rows, "p string",
        prefix=paths.under_dir(path, "/a/b"), bound=paths.under_dir(path, "/a/b", boundary=True),
        case=paths.under_dir(path, "/a/b", ignore_case=True),
    )
    assert got == [(True, True, True), (True, False, True), (False, False, True), (True, True, True)]


def test_date_expressions(spark):
    raw = [("2021:03:04 05:06:07",), ("2021:03",), ("no date",), ("a b c",)]
    got = [v[0] for v in values(spark, raw, "d string", d=dates.normalize_exif_date(F.col("d")))]
    assert got == ["2021-03-04T05:06:07", "2021-03", "noTdate", "aTb c"]
    rows = [("2021-03-04T05:06:07",), ("2021-03-04 05:06",), ("2021-03",), ("unknown",), (None,), ("2020-1-2-3",)]
    parts = [v[0] for v in values(spark, rows, "d string", d=dates.date_parts(F.col("d")))]
    assert [p and tuple(p) for p in parts] == [("2021", "03", "04"), ("2021", "03", "04"), None, None, None, ("2020", "1", "2")]
    filled = [v[0] for v in values(spark, rows[:1], "d string", f=dates.apply_template("YYYY/YYYY-MM-DD", dates.date_parts(F.col("d"))))]
    assert filled == ["2021/2021-03-04"]


def test_fingerprints(spark):
    rows = [([1.0, 0.0], [0.6, 0.8]), ([1.0], [1.0, 2.0]), ([], [])]
    got = values(spark, rows, "a array<double>, b array<double>", c=fingerprints.cosine(F.col("a"), F.col("b")), n=fingerprints.l2_normalize(F.col("b")))
    assert [round(g[0], 9) for g in got] == [0.6, 0.0, 0.0]
    assert got[2][1] is None
    rising = [[float(x) for _ in range(8) for x in range(9)], [float(-x) for _ in range(8) for x in range(9)], [1.0]]
    assert [v[0] for v in values(spark, [(r,) for r in rising], "c array<double>", h=fingerprints.gradient_hash(F.col("c")))] == [-1, 0, None]


FILES = "file_id string, path string, file_name string, file_type string, taken_at string, md5 string"


def test_organize_rules(spark):
    rows = [
        ("1", "/s/a.jpg", "a.jpg", "image", None, "m1"),  # undated, claims m1
        ("2", "/s/b.jpg", "b.jpg", "image", "2021-01-02T00:00:00", "m1"),  # blocked by the undated twin
        ("3", "/s/c/n.jpg", "n.jpg", "image", "2021-01-02T00:00:00", None),
        ("4", "/s/d/n.jpg", "n.jpg", "image", "2021-01-03T00:00:00", None),  # same name, no content check
        ("5", "/s/e.jpg", "e.jpg", "image", "garbage", "m5"),
        ("6", "/s/gone.jpg", "gone.jpg", "image", "2021-01-02T00:00:00", "m6"),
        ("7", "/s/f.jpg", "f.jpg", "image", "2021-01-02T00:00:00", "m7"),  # already in the target
        ("8", "/t/f.jpg", "f.jpg", "image", "2021-01-02T00:00:00", "m7"),
        ("9", "/s/g.jpg", "g.jpg", "image", "2021-01-02T00:00:00", "m9"),  # the target's copy is gone
        ("10", "/t/g.jpg", "g.jpg", "image", "2021-01-02T00:00:00", "m9"),
        ("11", "/s/h.mp3", "h.mp3", "audio", "2021-01-02T00:00:00", "m11"),
        ("12", "/s/noext", "noext", "image", "2021-01-02T00:00:00", "m12"),  # name taken on disk
    ]
    files = spark.createDataFrame(rows, FILES)
    there = [r[1] for r in rows if r[0] not in ("6", "10")] + ["/t/2021/noext"]
    listing = spark.createDataFrame([(p,) for p in there], "path string")
    plan = organize.organize_plan(files, listing, "/t", "YYYY", file_types=["image"])
    got = {r.file_id: (r.skip_reason, r.dest_path) for r in plan.collect()}
    assert {k: v[0] for k, v in got.items() if v[0]} == {
        "1": "no_date", "2": "same_content", "5": "bad_date", "6": "source_missing", "7": "same_content",
    }
    assert got["3"][1] == "/t/2021/n.jpg"
    assert got["4"][1].startswith("/t/2021/n_") and len(got["4"][1]) == len("/t/2021/n_123456.jpg")
    assert got["9"][1] == "/t/2021/g.jpg"
    assert got["12"][1].startswith("/t/2021/noext_")
    assert tuple(organize.organize_summary(plan).first()) == (9, 4, 5)


def test_conflicts_beyond_six_digits(spark):
    """Whatever collides, every destination stays distinct."""
    rows = [(f"/s/{i}/a.jpg", None, "/t", "a.jpg") for i in range(50)]
    wanted = spark.createDataFrame(rows, "path string, taken_at string, dest_dir string, file_name string")
    taken = wanted.select(F.concat(F.lit("/t/a_"), F.substring(F.md5("path"), 1, 6), F.lit(".jpg")).alias("path"))
    got = [r.dest_path for r in organize.resolve_conflicts(wanted, taken).collect()]
    assert len(set(got)) == 50 and not set(got) & {r.path for r in taken.collect()}


def test_decisions_replay(spark):
    rng = random.Random(8)
    members = [(f"g{g:02}", f"{g}-{m}", rng.randint(1, 9), f"/t/{g}/{m}") for g in range(12) for m in range(rng.randint(2, 5))]
    names = sorted({m[0] for m in members})
    log, kinds = [], [review.KEEP_ONLY, review.TOGGLE, review.TOGGLE, review.KEEP_ALL, review.DELETE_ALL, review.SKIP_BELOW]
    for seq in range(60):
        g, kind = rng.randrange(14), rng.choice(kinds)
        own = [m[1] for m in members if m[0] == f"g{g:02}"] or ["none"]
        log.append((g, rng.choice(own) if kind in (review.KEEP_ONLY, review.TOGGLE) else None, kind, seq))
    keep = {}
    for name in names:
        order = sorted((m for m in members if m[0] == name), key=lambda m: (-m[2], m[3]))
        keep.update({m[1]: k == 0 for k, m in enumerate(order)})
    for g, target, kind, _ in log:
        if g >= len(names):
            continue
        own = [m[1] for m in members if m[0] == names[g]]
        if kind == review.TOGGLE:
            keep[target] = not keep[target]
        elif kind == review.SKIP_BELOW:
            keep.update({m[1]: True for m in members if m[0] >= names[g]})
        else:
            keep.update({o: kind == review.KEEP_ALL or (kind == review.KEEP_ONLY and o == target) for o in own})
    frame = spark.createDataFrame(members, "group_id string, file_id string, file_size int, path string")
    actions = spark.createDataFrame(log, "group_ordinal long, file_id string, action string, seq long")
    decided = review.decide(frame, review.group_ordinals(frame), actions)
    assert {r.file_id: r.keep for r in decided.collect()} == keep
    total = review.reclaimable(decided).first()
    assert total.files == sum(not k for k in keep.values())
    assert total.bytes == sum(m[2] for m in members if not keep[m[1]])


def test_catalog_scopes_and_errors(spark):
    files = spark.createDataFrame([("1", "p", "/a")], "file_id string, project_id string, path string")
    new = spark.createDataFrame([("2", "q", "/a"), ("4", "q", "/b"), ("3", "q", "/b")], files.schema)
    assert [r.file_id for r in catalog.catalog_append(new, files).collect()] == ["3"]
    assert sorted(r.file_id for r in catalog.catalog_append(new, files, "project").collect()) == ["2", "3"]
    projects = spark.createDataFrame([("p", "n")], "project_id string, name string")
    roots = spark.createDataFrame([], "project_id string, root_id string, path string, created_at timestamp")
    assert catalog.project_detail(projects, roots, "p").first().roots == []
    with pytest.raises(LookupError):
        catalog.project_detail(projects, roots, "x")
