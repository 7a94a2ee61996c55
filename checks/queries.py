"""The registered queries: every relational operator on the driver's tables, the pipelines end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import file_queries, inputs
from pixelkin import fixtures
from pixelkin.config import DedupConfig
from pixelkin.functions import dates, fingerprints, paths
from pixelkin.operators import catalog, components, ordinals, pairs, review, split, vectors
from pixelkin.plans import dedup, organize
from pixelkin.session import materialize

_DOUBLED = ["file_id", "path", "phash", "md5"]


# --- expressions -------------------------------------------------------------------------------------


def classify_extension(spark, sf):
    return fixtures.catalog(spark, sf).select("file_id", paths.classify_extension(F.col("path")).alias("file_type"))


def file_name(spark, sf):
    path = F.col("path")
    name = paths.file_name(path)
    return fixtures.catalog(spark, sf).select(
        "file_id", name.alias("file_name"), paths.extension(path).alias("ext"), paths.file_stem(name).alias("stem")
    )


def normalize_exif_date(spark, sf):
    return fixtures.catalog(spark, sf).select("file_id", dates.normalize_exif_date(F.col("exif_raw")).alias("taken"))


def taken_at_fallback(spark, sf):
    rows = fixtures.catalog(spark, sf).selectExpr(
        "file_id",
        "path",
        "CASE file_id % 4 WHEN 0 THEN exif_raw WHEN 1 THEN '0000:00:00 00:00:00' WHEN 2 THEN '  ' END AS raw",
        "timestamp_seconds(1600000000 + file_id * 3607) AS modified_at",
    )
    kind = paths.classify_extension(F.col("path"))
    return rows.select("file_id", dates.taken_at(kind, F.col("raw"), F.col("modified_at")).alias("taken_at"))


def content_md5(spark, sf):
    return fixtures.table(spark, sf, "documents").select(
        "doc_id", fingerprints.content_md5(F.col("text").cast("binary")).alias("md5")
    )


def gradient_hash_array(spark, sf):
    rows = fixtures.table(spark, sf, "embeddings")
    cells = F.concat("embedding", F.slice("embedding", 1, 8))
    return rows.select("vec_id", fingerprints.gradient_hash(cells).alias("phash"))


def l2_normalize(spark, sf):
    unit = fingerprints.l2_normalize(F.col("embedding"))
    rows = fixtures.table(spark, sf, "embeddings").select("vec_id", unit.alias("u"))
    return rows.select("vec_id", F.posexplode("u").alias("pos", "x")).select(
        "vec_id", "pos", F.round("x", 6).alias("x")
    )


def date_parts(spark, sf):
    rows = fixtures.catalog(spark, sf).withColumn("d", dates.date_parts(F.col("taken_at")))
    return rows.select("file_id", "d.year", "d.month", "d.day")


def date_template_all(spark, sf):
    rows = fixtures.catalog(spark, sf).withColumn("d", dates.date_parts(F.col("taken_at")))
    rows = rows.withColumn("template", F.explode(F.array(*map(F.lit, dates.TEMPLATES))))
    return rows.select("file_id", "template", dates.apply_template(F.col("template"), F.col("d")).alias("folder"))


def relative_folder(spark, sf):
    return fixtures.catalog(spark, sf).select("file_id", paths.relative_folder(F.col("path"), "/library/").alias("folder"))


def under_dir_counts(spark, sf):
    path = F.col("path")
    return fixtures.catalog(spark, sf).groupBy("project_id").agg(
        F.count_if(paths.under_dir(path, "/library")).alias("by_prefix"),
        F.count_if(paths.under_dir(path, "/library", boundary=True)).alias("by_folder"),
        F.count_if(paths.under_dir(path, "/LIBRARY", ignore_case=True)).alias("any_case"),
        F.count_if(paths.under_dir(path, "\\library2")).alias("backslash"),
    )


def type_filter(spark, sf):
    rows = inputs.catalog(spark, sf)
    return rows.where(paths.of_types(F.col("file_type"), ["image", "audio"])).select("file_id", "file_type")


# --- pairs and comparisons ---------------------------------------------------------------------------


def hamming_pairs_le8(spark, sf):
    return pairs.hamming_pairs(inputs.near_files(spark, sf), 8)


def hamming_pairs_banded(spark, sf):
    hashes = inputs.near_files(spark, sf).select("phash").distinct()
    return pairs.band_hamming_pairs(hashes, 8, pairs.bands_for(8, 3))


def hamming_two_band(spark, sf):
    return pairs.two_band_pairs(inputs.near_files(spark, sf), 8, 12)


def cosine_pairs(spark, sf):
    points = inputs.near_files(spark, sf).select(F.col("file_id").cast("long").alias("id"), "vector")
    return vectors.cosine_pairs(points, 0.93)


def hamming_pairs_pivots(spark, sf):
    """The metric partition at the widest default reach, in small blocks."""
    hashes = materialize(inputs.near_files(spark, sf).select("phash").distinct(), "hashes")
    return pairs.pivot_hamming_pairs(hashes, 12, hashes.count(), 256)


def cosine_pairs_pivots(spark, sf):
    points = inputs.near_files(spark, sf).select(F.col("file_id").cast("long").alias("id"), "vector")
    points = materialize(points, "points")
    return vectors.pivot_cosine_pairs(points, 0.93, points.count(), 1.0 + 1e-9, 256)


def similarity_components(spark, sf):
    found = pairs.hamming_pairs(inputs.near_files(spark, sf), 8)
    return components.components(found)


def md5_groups(spark, sf):
    return dedup.exact_groups(fixtures.catalog(spark, sf))


def path_key_first(spark, sf):
    rows = fixtures.catalog(spark, sf).withColumn("phash", F.col("file_size") % 97)
    shouted = rows.select(
        (F.col("file_id") + 5000000).alias("file_id"),
        F.translate(F.upper("path"), "/", "\\").alias("path"),
        ((F.col("phash") * 31) % 97).alias("phash"),
        "md5",
    )
    return dedup.first_per_path_key(rows.select(*_DOUBLED).unionByName(shouted)).select("file_id", "path", "phash")


def need_vectors(spark, sf):
    rows = inputs.near_files(spark, sf)
    points = rows.groupBy(F.col("phash").alias("cid"), "phash").agg(F.count("*").alias("w"))
    placed = points.select("cid", F.col("cid").alias("cl"), F.lit(0).alias("seq"), F.col("w").alias("files"))
    found = pairs.hamming_pairs(rows, 12).where("dist > 8")
    # One pass: a union of both sides would search twice.
    suspects = found.select(F.explode(F.array("a", "b")).alias("phash")).distinct()
    need = dedup.needed_for_vectors(placed, suspects, points)
    return rows.join(need.select("phash"), "phash", "left_semi").select("file_id")


def verify_evictions(spark, sf):
    rows = inputs.near_files(spark, sf)
    points = rows.select(
        F.col("owner").alias("grp"),
        F.col("file_id").alias("id"),
        F.when(F.col("file_id").cast("long") % 17 != 0, F.col("vector")).alias("vector"),
        F.lit(1).cast("long").alias("w"),
    )
    return vectors.vector_evictions(points, 0.93, DedupConfig().chunk_rows).select(F.col("id").alias("file_id"))


def phash_validation(spark, sf):
    rows = inputs.near_files(spark, sf)
    points = rows.select(F.col("owner").alias("grp"), F.col("file_id").alias("id"), "phash", F.lit(1).cast("long").alias("w"))
    return vectors.hash_evictions(points, DedupConfig().max_ingroup_phash, DedupConfig().chunk_rows).select(F.col("id").alias("file_id"))


def oversized_split_phash(spark, sf):
    rows = inputs.near_files(spark, sf).groupBy((F.col("owner") % 25).alias("grp"), "phash").agg(F.min("path").alias("pos"))
    return split.split_by_first_fit(rows.select("grp", "pos", F.col("phash").cast("string").alias("id"), F.col("phash").alias("value")), "hamming", 4)


def oversized_split_cosine(spark, sf):
    rows = inputs.near_files(spark, sf).select(
        (F.col("owner") % 25).alias("grp"), F.col("path").alias("pos"), F.col("file_id").alias("id"), F.col("vector").alias("value")
    )
    return split.split_by_first_fit(rows, "cosine", DedupConfig().split_cosine)


# --- pipelines ---------------------------------------------------------------------------------------


def _run(spark, sf, mode, cfg=DedupConfig()):
    rows = inputs.near_files(spark, sf)
    return dedup.dedup(rows, rows.select("file_id", "vector"), mode, cfg)


def dedup_phash(spark, sf):
    return _run(spark, sf, "phash").groups


def dedup_phash_levels(spark, sf):
    """Components beyond what one task may hold: merged level by level."""
    return _run(spark, sf, "phash", DedupConfig(component_edge_limit=2)).groups


def dedup_phash_ai(spark, sf):
    return _run(spark, sf, "phash_ai").groups


def dedup_ai(spark, sf):
    return _run(spark, sf, "ai").groups


def dedup_summary(spark, sf):
    return _run(spark, sf, "phash_ai").summary.withColumn("methods", F.array_join("methods", "+"))


def dedup_summary_ai(spark, sf):
    return _run(spark, sf, "ai").summary.withColumn("methods", F.array_join("methods", "+"))


# --- catalog -----------------------------------------------------------------------------------------


def scan_summary(spark, sf):
    return catalog.scan_summary(inputs.listing(spark, sf))


def source_type_counts(spark, sf):
    return catalog.source_type_counts(inputs.catalog(spark, sf), inputs.TARGET)


def incremental_new_files(spark, sf):
    return catalog.new_listing_rows(inputs.listing(spark, sf), inputs.catalog(spark, sf), "p1").select("path")


def catalog_append(spark, sf):
    rows = inputs.listing(spark, sf).withColumn("file_id", F.md5("path"))
    twice = rows.unionByName(rows.withColumn("file_id", F.md5(F.upper("path"))).withColumn("file_size", F.col("file_size") + 1))
    known = inputs.catalog(spark, sf).where("project_id = 'p0'")
    return catalog.catalog_append(twice, known).select("path", "file_id", "file_size")


def one_row_per_path(spark, sf):
    rows = fixtures.catalog(spark, sf).select("file_id", F.regexp_replace("path", "/[0-9]+/", "/").alias("path"), "md5")
    return catalog.one_row_per_path(rows)


def stale_rows(spark, sf):
    return catalog.stale_rows(inputs.catalog(spark, sf), inputs.listing(spark, sf), "p0", inputs.TARGET).select("file_id", "path")


def cascade_delete(spark, sf):
    rows = inputs.catalog(spark, sf)
    projects, roots, files = catalog.cascade_delete(inputs.projects(spark, sf), inputs.roots(spark, sf), rows, "1")
    left = [
        projects.agg(F.count("*").alias("rows")).select(F.lit("projects").alias("name"), "rows"),
        roots.agg(F.count("*").alias("rows")).select(F.lit("roots").alias("name"), "rows"),
        catalog.cascade_delete(inputs.projects(spark, sf), inputs.roots(spark, sf), rows, "p1")[2]
        .agg(F.count("*").alias("rows"))
        .select(F.lit("files").alias("name"), "rows"),
    ]
    return left[0].union(left[1]).union(left[2])


def project_files(spark, sf):
    rows = catalog.project_files(inputs.catalog(spark, sf), "p2").select("file_id", "taken_at", "path")
    return ordinals.with_ordinal(rows, [F.col("taken_at").asc_nulls_first(), "path"], "position").drop("path")


def hash_files(spark, sf):
    rows = inputs.near_files(spark, sf).withColumn("project_id", F.concat(F.lit("p"), F.col("owner") % 3))
    rows = rows.withColumn("phash", F.when(F.col("owner") % 7 != 0, F.col("phash")))
    return catalog.hash_files(rows, "p1", "/LIBRARY/0").select("file_id", "phash")


def vector_cache_lookup(spark, sf):
    rows = inputs.near_files(spark, sf)
    cache = rows.where("phash < 0").select("file_id", "vector")
    return catalog.vector_lookup(rows.select("file_id"), cache).select(
        "file_id", F.col("vector").isNull().alias("missing"), F.round(F.col("vector")[0], 6).alias("first")
    )


def project_list(spark, sf):
    rows = catalog.project_list(inputs.projects(spark, sf))
    return ordinals.with_ordinal(rows, [F.col("created_at").desc(), "project_id"], "position").select("project_id", "name", "position")


def project_detail(spark, sf):
    rows = catalog.project_details(inputs.projects(spark, sf), inputs.roots(spark, sf))
    return rows.select(
        "project_id", F.size("roots").alias("n_roots"), F.array_join(F.transform("roots", lambda r: r["path"]), ";").alias("root_paths")
    )


def root_registration(spark, sf):
    rows = inputs.roots(spark, sf)
    known = fixtures.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("root_id"))
    return catalog.register_roots(rows.join(known, "root_id", "left_semi"), rows).select("project_id", "path", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


# --- organizing --------------------------------------------------------------------------------------


def target_md5_anti(spark, sf):
    rows = inputs.catalog(spark, sf)
    inside = paths.under_dir(F.col("path"), inputs.TARGET, boundary=True)
    return organize.not_in_target(rows.where(~inside), rows.where(inside)).select("file_id")


def existing_sources(spark, sf):
    return organize.existing_sources(inputs.catalog(spark, sf), inputs.listing(spark, sf)).select("file_id")


def content_claims(spark, sf):
    return organize.content_claims(inputs.catalog(spark, sf))


def destination_conflicts(spark, sf):
    rows = inputs.catalog(spark, sf).select("path", "taken_at", "file_name", F.lit("/library/in").alias("dest_dir"))
    disk = rows.where(F.length("path") % 2 == 0).select(F.concat(F.lit("/library/in/"), "file_name").alias("path")).distinct()
    return organize.resolve_conflicts(rows, disk).select("path", "dest_path")


def _plan(spark, sf):
    return organize.organize_plan(inputs.catalog(spark, sf), inputs.listing(spark, sf), inputs.TARGET, "YYYY/MM", "move", ["image", "video"])


def organize_plan(spark, sf):
    return _plan(spark, sf)


def organize_summary(spark, sf):
    return organize.organize_summary(_plan(spark, sf))


def organize_skip_reasons(spark, sf):
    return organize.skip_reasons(_plan(spark, sf))


# --- review ------------------------------------------------------------------------------------------


def _members(spark, sf) -> DataFrame:
    return review.group_members(inputs.content_groups(spark, sf), inputs.catalog(spark, sf))


def group_listing(spark, sf):
    rows = review.group_listing(inputs.content_groups(spark, sf), inputs.catalog(spark, sf))
    ordered = ordinals.with_group_ordinal(
        rows.select("group_id", "file_id", "file_size", "path", "group_size", "recommended"),
        ["group_id"], [F.col("file_size").desc(), "path"], "position",
    )
    return ordered.select("group_id", "file_id", "file_size", "group_size", "recommended", "position")


def recommended_keeper(spark, sf):
    return review.keepers(_members(spark, sf))


def folder_breakdown(spark, sf):
    return review.folder_breakdown(_members(spark, sf), inputs.TARGET)


def _decisions(spark, sf) -> DataFrame:
    groups = inputs.content_groups(spark, sf)
    numbers = materialize(review.group_ordinals(groups), "ordinals")
    return review.decide(_members(spark, sf), numbers, inputs.actions(spark, sf, numbers, groups))


def decisions(spark, sf):
    return _decisions(spark, sf)


def delete_list(spark, sf):
    return review.delete_list(_decisions(spark, sf))


def reclaimable(spark, sf):
    return review.reclaimable(_decisions(spark, sf))


QUERIES = [
    classify_extension, file_name, normalize_exif_date, taken_at_fallback, content_md5, gradient_hash_array,
    l2_normalize, date_parts, date_template_all, relative_folder, under_dir_counts, type_filter,
    hamming_pairs_le8, hamming_pairs_banded, hamming_two_band, cosine_pairs, hamming_pairs_pivots, cosine_pairs_pivots,
    similarity_components, md5_groups,
    path_key_first, need_vectors, verify_evictions, phash_validation, oversized_split_phash,
    oversized_split_cosine, dedup_phash, dedup_phash_levels, dedup_phash_ai, dedup_ai, dedup_summary, dedup_summary_ai,
    scan_summary, source_type_counts, incremental_new_files, catalog_append, one_row_per_path, stale_rows,
    cascade_delete, project_files, hash_files, vector_cache_lookup, project_list, project_detail,
    root_registration, target_md5_anti, existing_sources, content_claims, destination_conflicts, organize_plan,
    organize_summary, organize_skip_reasons, group_listing, recommended_keeper, folder_breakdown, decisions,
    delete_list, reclaimable, *file_queries.QUERIES,
]


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Default-mode grouping end to end, as the group listing a user reviews."""
    rows = inputs.near_files(spark, sf)
    run = dedup.dedup(rows, rows.select("file_id", "vector"))
    files = rows.select("file_id", "path", "phash", F.lit(1).cast("long").alias("file_size"))
    return review.group_listing(run.groups, files)
