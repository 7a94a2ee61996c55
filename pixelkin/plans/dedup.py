"""The three near-duplicate pipelines: by hash, by hash with vector verification, by vector alone.

Everything runs on distinct contents, not on files: files with one hash (or one vector) are a single
weighted point, so a family of copies costs one row in every join and comparison. The clustering result
is the one that a single ordered pass over all pairs of files would give.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixelkin.config import DedupConfig
from pixelkin.functions.paths import path_key, under_dir
from pixelkin.operators.catalog import vector_lookup
from pixelkin.operators.components import connected
from pixelkin.operators.families import BITS, COSINE, PLACE, Family, Likeness, fits, start_links, task_bytes
from pixelkin.operators.linkage import cluster_edges, complete_linkage
from pixelkin.operators.pairs import two_band_pairs
from pixelkin.operators.skew import keyed_join
from pixelkin.operators.split import split_by_first_fit
from pixelkin.operators.vectors import (
    cosine_pairs,
    hash_evictions,
    linked_cosine_pairs,
    self_similar,
    vector_evictions,
    vector_key,
)
from pixelkin.session import is_empty, materialize

PHASH, PHASH_AI, AI = "phash", "phash_ai", "ai"
_HASH_METHOD, _VECTOR_METHOD = "pHash", "vector"
Embedder = Callable[[DataFrame], DataFrame]

_SUMMARY = T.StructType(
    [
        T.StructField("total_target_images", T.LongType()),
        T.StructField("groups_found", T.LongType()),
        T.StructField("total_duplicates", T.LongType()),
        T.StructField("methods", T.ArrayType(T.StringType())),
        T.StructField("suspect_pairs_checked", T.LongType()),
        T.StructField("ai_confirmed", T.LongType()),
    ]
)
_TIMINGS = T.StructType([T.StructField("name", T.StringType()), T.StructField("duration_ms", T.LongType())])


@dataclass
class DedupRun:
    """``groups``: (file_id, group_id) of every file in a group of two or more.

    ``closed_folders``: folders (path) of the target that the flow could not read, and whose files it kept.
    """

    groups: DataFrame
    summary: DataFrame
    timings: DataFrame
    new_vectors: DataFrame | None = None
    closed_folders: DataFrame | None = None


@dataclass
class _Stages:
    """Wall-clock of the stages; each ends with a written table."""

    started: float = field(default_factory=time.monotonic)
    rows: list[tuple[str, int]] = field(default_factory=list)

    def mark(self, name: str) -> None:
        now = time.monotonic()
        self.rows.append((name, int((now - self.started) * 1000)))
        self.started = now

    def frame(self, spark: SparkSession) -> DataFrame:
        total = sum(ms for _, ms in self.rows)
        return spark.createDataFrame([*self.rows, ("total", total)], _TIMINGS)


def hash_bearing_files(files: DataFrame, target_dir: str | None = None) -> DataFrame:
    """Files with a hash, optionally below a target (ignoring case)."""
    kept = files.where(F.col("phash").isNotNull())
    return kept.where(under_dir(F.col("path"), target_dir, ignore_case=True)) if target_dir else kept


def first_per_path_key(files: DataFrame) -> DataFrame:
    """One row per path key: the first in hash order, then path order."""
    row = F.struct(*files.columns)
    first = files.groupBy(path_key(F.col("path")).alias("_key")).agg(
        F.min_by(row, F.struct("phash", "path", "file_id")).alias("_row")
    )
    return first.select("_row.*")


def exact_groups(files: DataFrame) -> DataFrame:
    """(file_id, md5_group): the smallest file id with the same content; files without MD5 stay alone."""
    known = files.where(F.col("md5").isNotNull()).select("file_id", "md5")
    heads = known.groupBy("md5").agg(F.min("file_id").alias("md5_group"), F.count("*").alias("n"))
    alone = files.where(F.col("md5").isNull()).select("file_id", F.col("file_id").alias("md5_group"))
    return keyed_join(known, materialize(heads, "heads"), "md5", "n").select("file_id", "md5_group").unionByName(alone)


# ---------------------------------------------------------------------------------------------------
# Starting clusters
# ---------------------------------------------------------------------------------------------------


def _unit() -> F.Column:
    """What the MD5 stage joins: all files of one content, or a file without MD5 by itself."""
    return F.coalesce(F.concat(F.lit("m"), "md5"), F.concat(F.lit("f"), "file_id"))


def _start_clusters(rows: DataFrame, value: str) -> tuple[DataFrame, bool]:
    """Rows with their starting cluster ``cid``; the flag tells that ``cid`` is simply the value.

    Equal values merge before anything else, so normally a value is a cluster. Only where one MD5 comes
    with several values are the contents that touch those values kept apart as MD5 units.
    """
    per_md5 = rows.where(F.col("md5").isNotNull()).groupBy("md5").agg(
        F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("known"), F.count("*").alias("n")
    )
    mixed = per_md5.where((F.col("lo") != F.col("hi")) | ((F.col("known") > 0) & (F.col("known") < F.col("n"))))
    mixed = mixed.select("md5")
    if is_empty(mixed):
        return rows.withColumn("cid", F.col(value)), True
    mixed = materialize(mixed, "mixed-md5")
    of_mixed = rows.join(mixed, "md5", "left_semi")
    touched = of_mixed.where(F.col(value).isNotNull()).select(value).distinct().withColumn("_touched", F.lit(True))
    flagged = rows.join(touched, value, "left").join(mixed.withColumn("_mixed", F.lit(True)), "md5", "left")
    apart = F.col("_touched").isNotNull() | F.col("_mixed").isNotNull()
    marked = flagged.withColumn(
        "cid", F.when(apart, _unit()).otherwise(F.concat(F.lit("v"), F.col(value).cast("string")))
    )
    return materialize(marked.select(*rows.columns, "cid"), "start-clusters"), False


def _hash_edges(points: DataFrame, pairs: DataFrame, plain: bool) -> DataFrame:
    """Cluster edges of the sure pairs, ranked by distance, then by the order of the two files."""
    if plain:
        sizes = points.select("phash", "w")
        sided = pairs
        for side in ("a", "b"):
            sided = sided.join(sizes.toDF(side, f"w{side}"), side)
        one = F.lit(1).cast("long")
        return sided.select(
            "a", "b", one.alias("na"), one.alias("nb"), "wa", "wb", one.alias("cnt"), F.struct("dist", F.col("a").alias("ha"), F.col("b").alias("hb")).alias("k")
        )
    same = points.select(F.col("phash").alias("a"), F.col("phash").alias("b"), F.lit(0).alias("dist")).distinct()
    left = points.select(F.col("phash").alias("a"), F.struct("phash", F.col("first_path").alias("path")).alias("ra"), F.col("cid").alias("ca"))
    right = points.select(F.col("phash").alias("b"), F.struct("phash", F.col("first_path").alias("path")).alias("rb"), F.col("cid").alias("cb"))
    joined = pairs.unionByName(same).join(left, "a").join(right, "b").where(F.col("ra") < F.col("rb"))
    ranked = joined.select(F.col("ca").alias("a"), F.col("cb").alias("b"), F.struct("dist", "ra", "rb").alias("k"))
    clusters = points.groupBy("cid").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    return cluster_edges(ranked, clusters)


def _placed(points: DataFrame, merged: DataFrame) -> DataFrame:
    """(cid, cl, seq, files, head): final cluster of every starting cluster, its size and smallest file id."""
    sizes = points.groupBy("cid").agg(F.sum("w").alias("w"), F.min("first_id").alias("first_id"))
    placed = sizes.join(merged, "cid", "left").select(
        "cid", F.coalesce("final", "cid").alias("cl"), F.coalesce("seq", F.lit(0)).alias("seq"), "w", "first_id"
    )
    totals = placed.groupBy("cl").agg(F.sum("w").alias("files"), F.min("first_id").alias("head"))
    return placed.join(totals, "cl").select("cid", "cl", "seq", "files", "head")


def _named(members: DataFrame) -> DataFrame:
    """(file_id, group_id) of ``members`` (file_id, cl): groups of two or more, named by their smallest id."""
    members = materialize(members, "members")
    heads = members.groupBy("cl").agg(F.min("file_id").alias("group_id"), F.count("*").alias("n")).where("n >= 2")
    return keyed_join(members, materialize(heads, "heads"), "cl", "n").select("file_id", "group_id")


def _split(members: DataFrame, metric: str, limit: float, cfg: DedupConfig) -> DataFrame:
    """Members (file_id, cl, files, pos, value) with oversized clusters split into parts; ``cl`` becomes text."""
    whole = members.withColumn("cl", F.col("cl").cast("string"))
    big = whole.where(F.col("files") > cfg.max_group_size)
    values = big.where(F.col("value").isNotNull()).groupBy("cl", "key").agg(
        F.min("pos").alias("pos"), F.any_value("value").alias("value")
    )
    parts = split_by_first_fit(
        values.select(F.col("cl").alias("grp"), "pos", F.col("key").alias("id"), "value"),
        metric,
        limit,
        cfg.split_point_limit,
        cfg.chunk_rows,
    )
    parts = parts.select(F.col("grp").alias("cl"), F.col("id").alias("key"), "part")
    # A member without a value fits nowhere and stands alone from here on.
    divided = big.join(parts, ["cl", "key"], "left").where(F.col("part").isNotNull())
    return whole.where(F.col("files") <= cfg.max_group_size).select("file_id", "cl").unionByName(
        divided.select("file_id", F.concat_ws("/", "cl", "part").alias("cl"))
    )


# ---------------------------------------------------------------------------------------------------
# Pipelines
# ---------------------------------------------------------------------------------------------------


def _drop_far_members(members: DataFrame, cfg: DedupConfig) -> DataFrame:
    """In-group hash check on members (file_id, cl, phash, ...); only mixed MD5 groups can fail it."""
    named = members.withColumn("_id", F.concat_ws("|", F.col("cl").cast("string"), F.col("phash").cast("string")))
    points = named.groupBy(F.col("cl").alias("grp"), "phash", F.col("_id").alias("id")).agg(F.count("*").alias("w"))
    out = hash_evictions(points, cfg.max_ingroup_phash, cfg.chunk_rows).select(F.col("id").alias("_id"))
    return named.join(out, "_id", "left_anti").drop("_id")


def _finish_by_hash(members: DataFrame, plain: bool, oversized: bool, cfg: DedupConfig) -> DataFrame:
    """Validation and split of members (file_id, cl, phash, path, order, head).

    Without mixed MD5 groups every cluster passes the validation by construction.
    """
    if plain and not oversized:
        return members.select("file_id", F.col("head").alias("group_id"))
    members = materialize(members, "members")
    if not plain:
        members = materialize(_drop_far_members(members, cfg), "members")
    sizes = members.groupBy("cl").agg(F.count("*").alias("files"))
    members = members.join(sizes, "cl").select(
        "file_id",
        "cl",
        "files",
        F.struct("order", "phash", "path").alias("pos"),
        F.col("phash").cast("string").alias("key"),
        F.col("phash").alias("value"),
    )
    return _named(_split(members, "hamming", cfg.split_phash, cfg))


def _hash_stage(rows: DataFrame, reach: int, cfg: DedupConfig, ordered: bool):
    """Hash pairs within ``reach`` and the clusters of the sure ones: pairs, rows, points, placement, plain flag."""
    clustered, plain = _start_clusters(rows, "phash")
    points = clustered.groupBy("cid", "phash").agg(
        F.count("*").alias("w"), F.min("path").alias("first_path"), F.min("file_id").alias("first_id")
    )
    points = materialize(points, "points")
    pairs = materialize(two_band_pairs(points, cfg.phash_threshold, reach, collapsed=plain), "hash-pairs")
    sure, family = pairs.where("sure").drop("sure"), None
    if plain:
        # Every hash is a cluster of one point.
        values = points.select(F.col("phash").alias("node"), "cid", "w", "phash")
        family = Family(sure.select("a", "b"), values, ["phash"], Likeness(BITS, bits=cfg.phash_threshold))
    merged = complete_linkage(lambda: _hash_edges(points, sure, plain), cfg, ordered, all_initiate=True, family=family)
    return pairs, clustered, points, materialize(_placed(points, merged), "placed"), plain


def _run_phash(rows: DataFrame, cfg: DedupConfig, stages: _Stages):
    _, clustered, _, placed, plain = _hash_stage(rows, cfg.phash_threshold, cfg, ordered=False)
    stages.mark("hash comparison")
    members = keyed_join(clustered, placed.where("files >= 2"), "cid", "files").select(
        "file_id", "cl", "phash", "path", F.struct("seq").alias("order"), "head"
    )
    oversized = not is_empty(placed.where(F.col("files") > cfg.max_group_size))
    groups = materialize(_finish_by_hash(members, plain, oversized, cfg), "groups")
    stages.mark("in-group validation")
    return groups, 0, 0, None


def _suspect_count(points: DataFrame, suspects: DataFrame, plain: bool, cfg: DedupConfig) -> int:
    """Number of file pairs in the suspect band, from the weights of the hashes alone."""
    per_hash = points.groupBy("phash").agg(F.sum("w").alias("w"))
    weighed = suspects.join(per_hash.toDF("a", "wa"), "a").join(per_hash.toDF("b", "wb"), "b")
    total = weighed.agg(F.coalesce(F.sum(F.col("wa") * F.col("wb")), F.lit(0))).first()[0]
    if not plain:
        units = points.where(F.col("cid").startswith("m"))
        one = units.select("cid", F.col("phash").alias("a"), F.col("w").alias("wa"))
        two = units.select("cid", F.col("phash").alias("b"), F.col("w").alias("wb"))
        inside = suspects.join(one, "a").join(two, ["cid", "b"])
        total -= inside.agg(F.coalesce(F.sum(F.col("wa") * F.col("wb")), F.lit(0))).first()[0]
    return int(total)


def needed_for_vectors(placed: DataFrame, suspect_hashes: DataFrame, points: DataFrame) -> DataFrame:
    """(cid, phash, cl, seq, files) of the contents whose vectors are worth having: grouped or suspect."""
    known = points.select("cid", "phash").join(placed, "cid")
    suspect = suspect_hashes.withColumn("_suspect", F.lit(True))
    flagged = known.join(suspect, "phash", "left")
    return flagged.where((F.col("files") >= 2) | F.col("_suspect").isNotNull()).drop("_suspect")


def _attach_vectors(rows: DataFrame, vectors: DataFrame | None, embedder: Embedder | None):
    """Rows with their cached or newly computed vector; also the new vectors, to be stored."""
    fresh = None
    if vectors is None:
        cached = rows.withColumn("vector", F.lit(None).cast("array<float>"))
    else:
        cached = vector_lookup(rows, vectors)
    if embedder is not None:
        cached = materialize(cached, "cached-vectors")
        missing = cached.where(F.coalesce(F.size("vector"), F.lit(0)) <= 0)
        fresh = materialize(embedder(missing.select("file_id", "path")), "new-vectors")
        element = cached.schema["vector"].dataType
        late = fresh.select("file_id", F.col("vector").cast(element).alias("_late"))
        cached = cached.join(late, "file_id", "left").withColumn(
            "vector", F.when(F.size("vector") > 0, F.col("vector")).otherwise(F.col("_late"))
        ).drop("_late")
        fresh = fresh.where(F.size("vector") > 0)
    return cached.withColumn("vkey", vector_key(F.col("vector"))), fresh


def _run_phash_ai(rows: DataFrame, vectors, embedder, cfg: DedupConfig, stages: _Stages):
    pairs, clustered, points, placed, plain = _hash_stage(rows, cfg.suspect_max, cfg, ordered=True)
    stages.mark("hash comparison")

    suspects = pairs.where(~F.col("sure"))
    suspect_count = _suspect_count(points, suspects, plain, cfg)
    hashes = suspects.select(F.col("a").alias("phash")).union(suspects.select("b")).distinct()
    need = materialize(needed_for_vectors(placed, hashes, points), "needed")
    wanted = keyed_join(clustered.drop("phash"), need, "cid", "files") if plain else clustered.join(need, ["cid", "phash"])
    wanted, fresh = _attach_vectors(wanted.select("file_id", "path", "phash", "cid", "cl", "seq", "files"), vectors, embedder)
    wanted = materialize(wanted, "vectors")
    spots = wanted.groupBy("cl", "cid", "phash", "vkey").agg(
        F.min("file_id").alias("pid"),
        F.min("path").alias("path"),
        F.count("*").alias("w"),
        F.any_value("vector").alias("vector"),
        F.any_value("files").alias("files"),
    )
    spots = materialize(spots, "spots")
    stages.mark("vector extraction")

    grouped = spots.where("files >= 2").select(F.col("cl").alias("grp"), F.col("pid").alias("id"), "vector", "w")
    evicted = vector_evictions(grouped, cfg.cosine_threshold, cfg.chunk_rows).select(F.col("id").alias("pid"), F.lit(True).alias("_out"))
    state = spots.drop("vector").join(evicted, "pid", "left").withColumn(
        "loose", F.col("_out").isNotNull() | (F.col("files") < 2)
    )
    home = F.when(F.col("loose"), F.concat(F.lit("p"), "pid")).otherwise(F.concat(F.lit("g"), F.col("cl").cast("string")))
    state = materialize(state.withColumn("home", home).drop("_out"), "verified")
    stages.mark("vector verification")

    seeing = spots.where(F.size("vector") > 0).select(F.col("phash").alias("key"), F.col("pid").alias("id"), "vector")
    starts = materialize(_starting_homes(pairs, suspects, seeing, state, plain, cfg), "starts")
    active = materialize(starts.select(F.explode(F.array("a", "b")).alias("home")).distinct(), "active")
    if is_empty(active):
        final = state.select("pid", F.col("home").alias("cl"), F.lit(0).cast("long").alias("late"), "loose", "w", "home")
    else:
        live = materialize(state.join(active, "home", "left_semi"), "active-spots")

        def edges() -> DataFrame:
            keys = materialize(live.select("phash").distinct(), "active-hashes")
            near = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"))
            for side in ("x", "y"):
                near = near.join(keys.withColumnRenamed("phash", side), side, "left_semi")
            near = near.unionByName(keys.select(F.col("phash").alias("x"), F.col("phash").alias("y")))
            points2 = seeing.join(live.select(F.col("pid").alias("id")), "id", "left_semi").select("key", "id", "vector")
            found = _point_pairs(near, points2, live, cfg)
            may_start = (F.bit_count(F.col("ra.phash").bitwiseXOR(F.col("rb.phash"))) > cfg.phash_threshold) & (
                F.col("ua") != F.col("ub")
            )
            ranked = found.select("a", "b", F.when(may_start, F.struct("ra", "rb")).alias("k"))
            sizes = live.groupBy(F.col("home").alias("cid")).agg(F.count("*").alias("n"), F.sum("w").alias("w"))
            return cluster_edges(ranked, sizes)

        values = live.join(seeing.select(F.col("id").alias("pid"), "vector"), "pid").select(
            F.col("home").alias("node"), F.col("home").alias("cid"), "w", "phash", "path", F.col("cid").alias("unit"), "vector"
        )
        family = Family(starts, values, ["phash", "path", "cid"], _confirming(cfg))
        merged = complete_linkage(edges, cfg, family=family)
        merged = merged.select(F.col("cid").alias("home"), F.col("final"), F.col("seq").alias("late"))
        final = state.join(merged, "home", "left").select(
            "pid", F.coalesce("final", "home").alias("cl"), F.coalesce("late", F.lit(0)).alias("late"), "loose", "w", "home"
        )
    final = materialize(final, "confirmed")
    # An evicted content stands for several files that only belong together again once something joined them.
    parts = final.groupBy("cl").agg(
        F.sum(F.when(F.col("loose"), F.col("w")).otherwise(0)).alias("single"),
        F.count_if("loose").alias("loose_homes"),
        F.max((~F.col("loose")).cast("int")).alias("kept"),
        F.sum("w").alias("files2"),
        F.min("pid").alias("head"),
    )
    # Kept members may come from several earlier groups, each of them one cluster.
    homes = final.where(~F.col("loose")).groupBy("cl").agg(F.count_distinct("home").alias("kept_homes"))
    parts = parts.join(homes, "cl", "left").withColumn("kept_homes", F.coalesce("kept_homes", F.lit(0)))
    joined = (F.col("loose_homes") + F.col("kept_homes")) > 1
    confirmed = parts.where(joined).agg(
        F.coalesce(F.sum(F.col("single") + F.col("kept_homes") - 1), F.lit(0))
    ).first()[0]
    whole = parts.where((F.col("files2") >= 2) & (joined | (F.col("kept") == 1))).select("cl", "head", "files2")
    whole = materialize(whole, "whole")
    oversized = not is_empty(whole.where(F.col("files2") > cfg.max_group_size))
    stages.mark("suspect confirmation")

    grouped_spots = final.join(whole, "cl").select("pid", F.col("cl").alias("end"), "late", "head")
    content = ["cl", "cid", "phash", "_v"]
    no_null = F.coalesce("vkey", F.lit("")).alias("_v")
    ids = state.select("pid", "cl", "cid", "phash", no_null, "w").join(grouped_spots, "pid")
    ids = materialize(ids.select(*content, "w", "end", "late", "head"), "grouped-contents")
    members = keyed_join(wanted.select("file_id", "path", "seq", "cl", "cid", "phash", no_null), ids, content, "w")
    members = members.select(
        "file_id", F.col("end").alias("cl"), "phash", "path", F.struct("late", "seq").alias("order"), "head"
    )
    groups = materialize(_finish_by_hash(members, plain, oversized, cfg), "groups")
    stages.mark("in-group validation")
    return groups, suspect_count, int(confirmed), fresh


def _confirming(cfg: DedupConfig) -> Likeness:
    """Suspects start merges, in the order of their files; clusters agree when all cross pairs are near by hash and vector."""
    return Likeness(PLACE, bits=cfg.suspect_max, cosine=cfg.cosine_threshold, above=cfg.phash_threshold)


def _starting_homes(pairs: DataFrame, suspects: DataFrame, seeing: DataFrame, state: DataFrame, plain: bool, cfg: DedupConfig) -> DataFrame:
    """Links (a, b) between clusters that tell which of them similar suspects of different MD5 units connect.

    Most suspects are of one family, whose sure pairs hang together. Its contents meet in one task, if it holds them; the
    other suspects are looked up one by one.
    """
    links, inside = suspects.select(F.col("a").alias("x"), F.col("b").alias("y")), None
    if plain:
        nodes = materialize(connected(pairs.where("sure").select("a", "b")).toDF("phash", "component"), "families")
        spots = state.join(nodes, "phash").join(seeing.select(F.col("id").alias("pid"), "vector"), "pid")
        spots = materialize(spots.select("component", F.col("home").alias("cid"), "w", "phash", "path", F.col("cid").alias("unit"), "vector"), "family-spots")
        sizes = spots.groupBy("component").agg(F.count("*").alias("points"), F.max(F.size("vector")).alias("width"))
        held = sizes.where(fits(F.col("points"), F.col("width"), task_bytes(cfg))).select("component")
        nodes = materialize(nodes.join(held, "component", "left_semi").select("phash", "component"), "held-families")
        inside = start_links(spots.join(held, "component", "left_semi"), ["phash", "path", "cid"], _confirming(cfg))
        for side in ("x", "y"):
            links = links.join(nodes.toDF(side, f"c{side}"), side, "left")
        apart = F.col("cx").isNull() | F.col("cy").isNull() | (F.col("cx") != F.col("cy"))
        links = materialize(links.where(apart).select("x", "y"), "links")
        ends = links.select(F.explode(F.array("x", "y")).alias("key")).distinct()
        seeing = seeing.join(ends, "key", "left_semi")
    starts = _point_pairs(links, seeing, state, cfg)
    starts = starts.where((F.col("ua") != F.col("ub")) & (F.col("a") != F.col("b"))).select("a", "b")
    return starts if inside is None else inside.unionByName(starts)


def _point_pairs(links: DataFrame, points: DataFrame, state: DataFrame, cfg: DedupConfig) -> DataFrame:
    """Similar point pairs with their clusters (a, b), MD5 units (ua, ub) and ranks (ra < rb)."""
    found = linked_cosine_pairs(links, points, cfg.cosine_threshold, cfg.chunk_rows).select(
        F.col("a").alias("p"), F.col("b").alias("q")
    )
    for side, out in (("p", "1"), ("q", "2")):
        known = state.select(
            F.col("pid").alias(side),
            F.struct(F.struct("phash", "path").alias("r"), F.col("home").alias("c"), F.col("cid").alias("u")).alias("s" + out),
        )
        found = found.join(known, side)
    first, second = F.least("s1", "s2"), F.greatest("s1", "s2")
    ordered = found.select(first.alias("i"), second.alias("j"))
    return ordered.select(
        F.col("i.c").alias("a"),
        F.col("j.c").alias("b"),
        F.col("i.u").alias("ua"),
        F.col("j.u").alias("ub"),
        F.col("i.r").alias("ra"),
        F.col("j.r").alias("rb"),
    )


def _run_ai(rows: DataFrame, vectors, embedder, cfg: DedupConfig, stages: _Stages):
    seen, fresh = _attach_vectors(rows, vectors, embedder)
    # A vector of no length resembles nothing, so it counts as missing here.
    usable = F.when(self_similar(F.col("vector"), cfg.cosine_threshold), F.col("vkey"))
    seen = materialize(seen.withColumn("vkey", F.when(F.col("vkey").isNotNull(), usable)), "vectors")
    stages.mark("vector extraction")

    slim = seen.select("file_id", "path", "phash", "md5", "vkey")
    clustered, plain = _start_clusters(slim, "vkey")
    points = clustered.groupBy("cid", "vkey").agg(
        F.count("*").alias("w"), F.min(F.struct("phash", "path")).alias("rank"), F.min("file_id").alias("first_id")
    )
    points = materialize(points.where(F.col("cid").isNotNull()), "points")
    distinct = seen.where(F.col("vkey").isNotNull()).groupBy(F.col("vkey").alias("id")).agg(
        F.any_value("vector").alias("vector")
    )
    # Numbers instead of digests name the vectors in pairs, of which there may be very many.
    distinct = materialize(distinct.withColumn("num", F.monotonically_increasing_id()), "distinct-vectors")
    numbers = distinct.select(F.col("id").alias("vkey"), "num")
    pairs = cosine_pairs(distinct.select(F.col("num").alias("id"), "vector"), cfg.cosine_threshold)
    pairs = materialize(pairs, "vector-pairs")
    units = clustered.where(F.col("vkey").isNotNull()).groupBy("vkey", _unit().alias("unit")).agg(F.count("*").alias("w"))
    units = units.join(numbers, "vkey").select(F.col("num").alias("vkey"), "unit", "w")
    suspect_count = _similar_file_pairs(units, pairs, plain)

    numbered = materialize(points.where(F.col("vkey").isNotNull()).join(numbers, "vkey"), "numbered-points")
    family = None
    if plain:
        # Every vector is a cluster of one point.
        values = numbered.join(distinct.select("num", "vector"), "num").select(
            F.col("num").alias("node"), "cid", "w", "rank", "vector"
        )
        family = Family(pairs.select("a", "b"), values, ["rank", "cid"], Likeness(COSINE, cosine=cfg.cosine_threshold))

    def edges() -> DataFrame:
        ranked = _vector_ranks(pairs, numbered, plain)
        sizes = points.groupBy("cid").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
        return cluster_edges(ranked, sizes)

    merged = complete_linkage(edges, cfg, all_initiate=True, family=family)
    placed = materialize(_placed(points, merged), "placed")

    apart = clustered.groupBy("cid").agg(F.count_distinct(_unit()).alias("units"))
    apart = apart.join(placed, "cid").groupBy("cl").agg(F.sum("units").alias("units"))
    confirmed = apart.agg(F.coalesce(F.sum(F.col("units") - 1), F.lit(0))).first()[0]
    stages.mark("vector comparison")

    named = keyed_join(clustered, placed.where("files >= 2"), "cid", "files")
    members = named.select("file_id", F.col("cl"), "files", "seq", "phash", "path", "vkey")
    # Contents without vector are grouped by MD5 alone.
    blind = clustered.where(F.col("cid").isNull() & F.col("md5").isNotNull())
    counts = blind.groupBy("md5").agg(F.count("*").alias("files")).where("files >= 2")
    blind = blind.join(counts, "md5").select(
        "file_id", _unit().alias("cl"), "files", F.lit(0).cast("long").alias("seq"), "phash", "path", "vkey"
    )
    members = members.unionByName(blind)
    members = materialize(members, "members")
    if is_empty(members.where(F.col("files") > cfg.max_group_size)):
        groups = _named(members.select("file_id", "cl"))
    else:
        values = distinct.select(F.col("id").alias("vkey"), F.col("vector").alias("value"))
        shaped = members.join(values, "vkey", "left").select(
            "file_id", "cl", "files", F.struct("seq", "phash", "path").alias("pos"), F.col("vkey").alias("key"), "value"
        )
        groups = _named(_split(shaped, "cosine", cfg.split_cosine, cfg))
    groups = materialize(groups, "groups")
    stages.mark("oversized split")
    return groups, suspect_count, int(confirmed), fresh


def _vector_ranks(pairs: DataFrame, numbered: DataFrame, plain: bool) -> DataFrame:
    """Similar pairs (a, b, k) of clusters, ranked by similarity, then by the order of the two files."""
    pairs = pairs.select("a", "b", F.negative("sim").alias("far"))
    if not plain:
        own = numbered.select("num").distinct()
        self_pairs = own.select(F.col("num").alias("a"), F.col("num").alias("b"), F.lit(-1.0).alias("far"))
        pairs = pairs.unionByName(self_pairs)
    for side in ("a", "b"):
        known = numbered.select(F.col("num").alias(side), F.struct("rank", "cid").alias(f"r{side}"))
        pairs = pairs.join(known, side)
    i, j = F.least("ra", "rb"), F.greatest("ra", "rb")
    ranked = pairs.where(F.col("ra") != F.col("rb")).select("a", "b", "far", i.alias("i"), j.alias("j"))
    # A pair of one vector with itself comes in both directions.
    ranked = ranked.where((F.col("a") != F.col("b"))).unionByName(
        ranked.where(F.col("a") == F.col("b")).dropDuplicates(["i", "j"])
    )
    return ranked.select(
        F.col("i.cid").alias("a"),
        F.col("j.cid").alias("b"),
        F.struct("far", F.col("i.rank").alias("ri"), F.col("j.rank").alias("rj")).alias("k"),
    )


def _similar_file_pairs(units: DataFrame, pairs: DataFrame, plain: bool) -> int:
    """Number of similar file pairs of different MD5, from weights alone."""
    per_vector = units.groupBy("vkey").agg(
        F.sum("w").alias("w"), F.sum(F.col("w") * F.col("w")).alias("squares")
    )
    inside = per_vector.agg(F.coalesce(F.sum((F.col("w") * F.col("w") - F.col("squares")) / 2), F.lit(0.0))).first()[0]
    sizes = per_vector.select("vkey", "w")
    across = pairs.join(sizes.toDF("a", "wa"), "a").join(sizes.toDF("b", "wb"), "b")
    total = across.agg(F.coalesce(F.sum(F.col("wa") * F.col("wb")), F.lit(0))).first()[0] + inside
    if not plain:
        one, two = units.toDF("a", "unit", "wa"), units.toDF("b", "unit", "wb")
        same = pairs.join(one, "a").join(two, ["unit", "b"])
        total -= same.agg(F.coalesce(F.sum(F.col("wa") * F.col("wb")), F.lit(0))).first()[0]
    return int(total)


def dedup(
    files: DataFrame,
    vectors: DataFrame | None = None,
    mode: str = PHASH_AI,
    cfg: DedupConfig = DedupConfig(),
    target_dir: str | None = None,
    embedder: Embedder | None = None,
) -> DedupRun:
    """Group the near-duplicates of one project's ``files`` (file_id, path, phash, md5).

    ``vectors`` (file_id, vector) is the cache of normalized feature vectors; ``embedder`` computes missing
    ones from (file_id, path). An unknown mode runs the combined pipeline. Without any vector source the
    combined pipeline is the hash pipeline, and the vector pipeline is an error.
    """
    spark = files.sparkSession
    stages = _Stages()
    can_see = vectors is not None or embedder is not None
    if mode == AI and not can_see:
        raise ValueError("the vector pipeline needs vectors or an embedder")
    slim = files.select(F.col("file_id").cast("string").alias("file_id"), "path", "phash", "md5")
    rows = materialize(first_per_path_key(hash_bearing_files(slim, target_dir)), "dedup-files")
    total = rows.count()
    stages.mark("files")
    if vectors is not None:
        vectors = vectors.select(F.col("file_id").cast("string").alias("file_id"), "vector")
    if mode == PHASH or (mode != AI and not can_see):
        methods = [_HASH_METHOD]
        groups, suspects, confirmed, fresh = _run_phash(rows, cfg, stages)
    elif mode == AI:
        methods = [_VECTOR_METHOD]
        groups, suspects, confirmed, fresh = _run_ai(rows, vectors, embedder, cfg, stages)
    else:
        methods = [_HASH_METHOD, _VECTOR_METHOD]
        groups, suspects, confirmed, fresh = _run_phash_ai(rows, vectors, embedder, cfg, stages)
    found = groups.agg(F.count_distinct("group_id"), F.count("*")).first()
    if not total:
        methods = []
    summary = spark.createDataFrame([(total, found[0], found[1], methods, suspects, confirmed)], _SUMMARY)
    return DedupRun(groups, summary, stages.frame(spark), fresh)
