"""Registered queries of the jobs on files and stored tables: the texts of ``documents`` become files of the scratch folder."""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import inputs
from pixelkin import fixtures
from pixelkin.functions import dates, fingerprints
from pixelkin.operators import catalog
from pixelkin.plans import dedup, deletes, organize
from pixelkin.schemas import FILES, GROUPS, VECTORS
from pixelkin.session import materialize, scratch_dir
from pixelkin.sources import listing, media, storage
from pixelkin.streaming.ingest import ingest

TAKEN = (
    "concat(2020 + doc_id % 6, '-', lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0'), '-', "
    "lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0'), 'T10:20:30')"
)


def _write(batches):
    for batch in batches:
        # One text after the other becomes a Python object; a batch of them may be large.
        for path, text in zip(batch.column("path"), batch.column("text")):
            system, inner = storage.locate(path.as_py())
            system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(inner, compression=None) as out:
                out.write((text.as_py() or "").encode())
        yield batch.select(["path"])


def _new_folder(spark) -> str:
    return f"{scratch_dir(spark)}/files-{uuid.uuid4().hex}"


def _written(spark, sf: str, root: str) -> None:
    """One file per document below ``root``/src, written by tasks."""
    docs = fixtures.table(spark, sf, "documents")
    path = F.concat(F.lit(f"{root}/src/"), F.col("doc_id") % 10, F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".mp3"))
    materialize(docs.select(path.alias("path"), "text").mapInArrow(_write, "path string"), "written")


def _doc_id(name: str = "file_name"):
    return F.regexp_extract(name, r"(\d+)\.mp3$", 1).cast("long")


def file_round_trip(spark, sf) -> DataFrame:
    """Write, list, hash, plan, copy; then list and hash what has arrived."""
    root = _new_folder(spark)
    _written(spark, sf, root)
    found = materialize(listing.list_media(spark, [f"{root}/src"]), "listed")
    rows = found.join(media.read_contents(found), "path").withColumn("doc_id", _doc_id())
    rows = rows.withColumn("taken_at", F.expr(TAKEN)).withColumn("file_id", F.col("doc_id").cast("string"))
    rows = materialize(rows.select("file_id", "path", "file_name", "file_type", "taken_at", "md5"), "catalogued")
    plan = organize.organize_plan(rows, found, f"{root}/lib", "YYYY/MM/DD", "copy")
    status = organize.execute_organize(plan)
    arrived = materialize(listing.list_media(spark, [f"{root}/lib"]), "arrived")
    contents = arrived.join(media.read_contents(arrived), "path")
    done = status.where(F.col("status") == organize.DONE).select(F.col("dest_path").alias("path"))
    return contents.join(done, "path").select(
        F.regexp_extract("path", r"/lib/(.*)/[^/]*$", 1).alias("folder"), "file_name", "md5", "file_size"
    )


def file_move(spark, sf) -> DataFrame:
    """Move every content once, ask again for some of the moves by odd names, and list where all files are then."""
    root = _new_folder(spark)
    _written(spark, sf, root)
    found = materialize(listing.list_media(spark, [f"{root}/src"]), "listed")
    rows = found.join(media.read_contents(found), "path").withColumn("doc_id", _doc_id())
    rows = rows.withColumn("taken_at", F.expr(TAKEN)).withColumn("file_id", F.col("doc_id").cast("string"))
    rows = materialize(rows.select("file_id", "path", "file_name", "file_type", "taken_at", "md5"), "catalogued")
    plan = materialize(organize.organize_plan(rows, found, f"{root}/lib", "YYYY/MM", "move"), "move-plan")
    moved = organize.execute_organize(plan)
    # The destinations once more, as sources that are to move to themselves by another spelling.
    here = moved.where(F.col("status") == organize.DONE).select("file_id", F.col("dest_path").alias("path"))
    odd = F.regexp_replace("path", r"/([^/]*)$", "//./$1")
    again = here.select("file_id", "path", F.lit("move").alias("action"), F.lit(organize.READY).alias("status"), F.lit(None).cast("string").alias("skip_reason"), odd.alias("dest_path"))
    second = organize.execute_organize(again)
    places = materialize(listing.list_media(spark, [f"{root}/src", f"{root}/lib"]), "arrived")
    held = places.join(media.read_contents(places), "path").withColumn("doc_id", _doc_id())
    noted = second.select(F.col("path"), F.col("skip_reason").alias("second"))
    return held.join(noted, "path", "left").select(
        "doc_id", F.when(F.col("path").contains("/lib/"), "lib").otherwise("src").alias("place"), "md5", "second"
    )


def guarded_delete_files(spark, sf) -> DataFrame:
    """Delete every third document's file, ask for others outside the target, and list what is left."""
    root = _new_folder(spark)
    _written(spark, sf, root)
    found = materialize(listing.list_media(spark, [f"{root}/src"]).withColumn("doc_id", _doc_id()), "listed")
    outside = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit(f"{root}/src/../src/"), "file_name")).otherwise(F.col("path"))
    doomed = found.where("doc_id % 3 < 2").select(outside.alias("path"))
    status = deletes.execute_deletes(doomed, f"{root}/src", dry_run=False)
    left = listing.list_media(spark, [f"{root}/src"]).select("path", F.lit("left").alias("status"))
    return status.unionByName(left).select(_doc_id("path").alias("doc_id"), "status")


def ingest_files(spark, sf) -> DataFrame:
    """The stream over the written files, twice: the second round finds nothing new."""
    root = _new_folder(spark)
    _written(spark, sf, root)
    for _ in range(2):
        ingest(spark, f"{root}/src", f"{root}/files", f"{root}/mark", "p", lambda path: None).awaitTermination()
    rows = catalog.read_table(spark, f"{root}/files", FILES)
    return rows.select(_doc_id("path").alias("doc_id"), "file_name", "file_size", "file_type", "md5")


def group_write(spark, sf) -> DataFrame:
    """Groups of two projects are stored; those of the second are then replaced by fewer."""
    path = f"{_new_folder(spark)}/groups"
    owned = inputs.content_groups(spark, sf).join(inputs.catalog(spark, sf).select("file_id", "project_id"), "file_id")
    owned = materialize(owned, "owned-groups")
    for project, wanted in (("p0", "true"), ("p1", "true"), ("p1", "file_id % 2 = 0")):
        mine = owned.where(F.col("project_id") == project).where(wanted)
        catalog.store_groups(mine.drop("project_id"), project, path)
    return catalog.read_table(spark, path, GROUPS)


def vector_merge(spark, sf) -> DataFrame:
    """Vectors are stored for some files, then offered for others and some of the same again."""
    path = f"{_new_folder(spark)}/vectors"
    rows = fixtures.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("file_id"), "vec_id", F.col("embedding").alias("vector"))
    other = F.transform("vector", lambda x: -x)
    catalog.store_vectors(rows.where("vec_id % 3 = 0"), catalog.read_table(spark, path, VECTORS), path)
    again = rows.where("vec_id % 2 = 0").withColumn("vector", F.when(F.col("vec_id") % 3 == 0, other).otherwise(F.col("vector")))
    catalog.store_vectors(again.unionByName(again), catalog.read_table(spark, path, VECTORS), path)
    stored = catalog.read_table(spark, path, VECTORS)
    return stored.select("file_id", F.size("vector").alias("width"), F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("x0"))


def cosine_column(spark, sf) -> DataFrame:
    """Cosine of every vector with the next one; the last meets one of another length."""
    unit = fixtures.table(spark, sf, "embeddings").select("vec_id", fingerprints.l2_normalize(F.col("embedding")).alias("u"))
    following = unit.select((F.col("vec_id") - 1).alias("vec_id"), F.col("u").alias("v"))
    both = unit.join(following, "vec_id", "left")
    value = fingerprints.cosine(F.col("u"), F.coalesce("v", F.array(F.lit(1.0))))
    return both.select("vec_id", F.round(value, 6).alias("cosine"))


def taken_at_fractions(spark, sf) -> DataFrame:
    """File times with none, three or six digits of a fraction."""
    rows = fixtures.table(spark, sf, "documents").selectExpr(
        "doc_id",
        "1600000000000000 + doc_id * 3607000000 + CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN doc_id * 7 % 1000 * 1000 ELSE doc_id * 7919 % 1000000 END AS us",
    )
    moment = F.timestamp_micros("us")
    return rows.select("doc_id", dates.taken_at(F.lit("video"), F.lit(None).cast("string"), moment).alias("taken_at"))


def overlapping_roots(spark, sf) -> DataFrame:
    """Files below a root and a root inside it: the walk tells both, the catalog gets each file once."""
    root = _new_folder(spark)
    _written(spark, sf, root)
    roots = [f"{root}/src", f"{root}/src/3", f"{root}/none"]
    found = materialize(listing.walk(spark, roots), "walked")
    counts = found.groupBy("path").agg(F.count("*").alias("n_roots"), F.max("file_size").alias("file_size"))
    fresh = catalog.new_listing_rows(materialize(listing.list_media(spark, roots), "listed"), spark.createDataFrame([], FILES), "p")
    once = fresh.select("path").distinct().withColumn("listed", F.lit(True))
    return counts.join(once, "path", "left").select(_doc_id("path").alias("doc_id"), "n_roots", "file_size", F.coalesce("listed", F.lit(False)).alias("listed"))


def _head(kind: int, first: str, second: str) -> bytes:
    """A JPEG or TIFF head, little or big endian, with a date in the main directory and one in the embedded directory."""
    end = "<" if kind % 2 else ">"
    mark = (b"II" if kind % 2 else b"MM") + struct.pack(end + "HI", 42, 8)
    texts = [t.encode() + b"\x00" for t in (first, second)]
    at = 8 + 2 + 24 + 4
    main = struct.pack(end + "H", 2) + struct.pack(end + "HHII", 0x0132, 2, len(texts[0]), at)
    main += struct.pack(end + "HHII", 0x8769, 4, 1, at + len(texts[0])) + struct.pack(end + "I", 0)
    inner = struct.pack(end + "H", 1) + struct.pack(end + "HHII", 0x9003, 2, len(texts[1]), at + len(texts[0]) + 18)
    tiff = mark + main + texts[0] + inner + struct.pack(end + "I", 0) + texts[1]
    if kind < 2:
        return tiff
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\x00\x00" + tiff + b"\xff\xd9"


def _write_heads(batches):
    for batch in batches:
        for path, kind, first, second in zip(batch["path"], batch["kind"], batch["first"], batch["second"]):
            system, inner = storage.locate(path)
            system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(inner, compression=None) as out:
                out.write(_head(kind, first, second) if kind < 4 else first.encode())
        yield batch[["path"]]


def exif_dates(spark, sf) -> DataFrame:
    """Image heads of four kinds and files without any, written from the documents, read back as capture dates."""
    root = _new_folder(spark)
    stamp = "concat(2000 + doc_id % {0}, ':', lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0'), ':05 07:08:09')"
    rows = fixtures.table(spark, sf, "documents").selectExpr(
        f"concat('{root}/', lpad(CAST(doc_id AS STRING), 9, '0'), CASE WHEN doc_id % 5 < 2 THEN '.tif' ELSE '.jpg' END) AS path",
        "CAST(doc_id % 5 AS INT) AS kind",
        f"CASE doc_id % 3 WHEN 0 THEN {stamp.format(20)} WHEN 1 THEN '0000:00:00 00:00:00' ELSE '      ' END AS first",
        f"{stamp.format(7)} AS second",
    )
    materialize(rows.mapInPandas(_write_heads, "path string"), "heads")
    found = media.read_contents(materialize(listing.list_media(spark, [root]), "listed"))
    raw = found.select(F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long").alias("doc_id"), "exif_raw")
    return raw.select("doc_id", "exif_raw", dates.taken_at(F.lit("image"), F.col("exif_raw"), F.lit(None).cast("timestamp")).alias("taken_at"))


def _stand_in():
    """A model without weights: the mean of every channel over the outer fields of a grid of 4 x 4."""
    return lambda array: array.reshape(3, 4, 56, 4, 56).mean(axis=(2, 4), dtype=np.float64)[:, :, ::3]


def _pattern(path: str):
    """The picture of a file name: a grey level that follows its number, dark on the left; every ninth is broken."""
    number = int(path.rsplit("/", 1)[1].split(".")[0])
    if number % 9 == 0:
        return None
    pixels = np.full((64, 96, 3), 40 + number % 100, np.uint8)
    pixels[:, :48] = 10 + number % 7
    return pixels


def embedded_images(spark, sf) -> DataFrame:
    """A feature vector for every row of ``embeddings`` through decoder, resizing, scaling and a stand-in model."""
    rows = fixtures.table(spark, sf, "embeddings").selectExpr(
        "CAST(vec_id AS STRING) AS file_id", "concat('/pictures/', vec_id, '.png') AS path", "vec_id % 1000000 AS file_size"
    )
    found = media.embedder(_stand_in, _pattern)(rows)
    at = [0, 1, 9, 17]
    return found.select(
        F.col("file_id").cast("long").alias("vec_id"), F.size("vector").alias("width"),
        *(F.round(F.get("vector", F.lit(k)).cast("double"), 4).alias(f"x{k}") for k in at),
    )


def stage_names(spark, sf) -> DataFrame:
    """The stages whose times the pipelines report, in order, and whether the total is their sum."""
    rows = inputs.near_files(spark, sf)
    out = None
    for mode in ("phash", "phash_ai", "ai"):
        timed = dedup.dedup(rows, rows.select("file_id", "vector"), mode).timings.collect()
        total = sum(r["duration_ms"] for r in timed[:-1])
        one = spark.createDataFrame(
            [(mode, k, r["name"], r["duration_ms"] >= 0 and timed[-1]["duration_ms"] == total) for k, r in enumerate(timed)],
            "mode string, position int, name string, adds_up boolean",
        )
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = [
    overlapping_roots, exif_dates, embedded_images, stage_names,
    file_round_trip, file_move, guarded_delete_files, ingest_files, group_write, vector_merge, cosine_column, taken_at_fractions,
]

_WRITTEN = """w AS (SELECT doc_id, md5(coalesce(text, '')) AS md5, strlen(coalesce(text, ''))::BIGINT AS file_size,
 concat(lpad(CAST(doc_id AS VARCHAR), 9, '0'), '.mp3') AS file_name,
 concat(2020 + doc_id % 6, '/', lpad(CAST(1 + doc_id % 12 AS VARCHAR), 2, '0'), '/', lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0')) AS folder
FROM documents)"""

ORACLES = {
    "overlapping_roots": """SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 2 ELSE 1 END::BIGINT AS n_roots, strlen(coalesce(text, ''))::BIGINT AS file_size,
 true AS listed FROM documents""",
    "exif_dates": """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 5 < 4 THEN concat(2000 + doc_id % CASE WHEN doc_id % 3 = 0 THEN 20 ELSE 7 END, ':',
  lpad(CAST(1 + doc_id % 12 AS VARCHAR), 2, '0'), ':05 07:08:09') END AS exif_raw FROM documents)
SELECT doc_id, exif_raw, replace(substr(exif_raw, 1, 10), ':', '-') || 'T' || substr(exif_raw, 12) AS taken_at FROM t""",
    "embedded_images": """WITH p AS (SELECT vec_id, vec_id % 9 = 0 AS broken, 10 + vec_id % 7 AS dark, 40 + vec_id % 100 AS light FROM embeddings),
c AS (SELECT *, unnest([0, 1, 2]) AS ch, unnest([0.485, 0.456, 0.406]) AS mean, unnest([0.229, 0.224, 0.225]) AS std FROM p),
v AS (SELECT vec_id, broken, ch, (dark / 255.0 - mean) / std AS d, (light / 255.0 - mean) / std AS l FROM c),
n AS (SELECT vec_id, broken, sqrt(sum(4 * d * d + 4 * l * l)) AS nrm, max(CASE WHEN ch = 0 THEN d END) AS d0, max(CASE WHEN ch = 0 THEN l END) AS l0,
  max(CASE WHEN ch = 1 THEN l END) AS l1, max(CASE WHEN ch = 2 THEN l END) AS l2 FROM v GROUP BY ALL)
SELECT vec_id, CASE WHEN NOT broken THEN 24 END::INTEGER AS width, CASE WHEN NOT broken THEN round(d0 / nrm, 4) END AS x0,
  CASE WHEN NOT broken THEN round(l0 / nrm, 4) END AS x1, CASE WHEN NOT broken THEN round(l1 / nrm, 4) END AS x9,
  CASE WHEN NOT broken THEN round(l2 / nrm, 4) END AS x17 FROM n""",
    "stage_names": """WITH m AS (SELECT unnest([
  {'mode': 'phash', 'names': ['files', 'hash comparison', 'in-group validation', 'total']},
  {'mode': 'phash_ai', 'names': ['files', 'hash comparison', 'vector extraction', 'vector verification', 'suspect confirmation', 'in-group validation', 'total']},
  {'mode': 'ai', 'names': ['files', 'vector extraction', 'vector comparison', 'oversized split', 'total']}]) AS x)
SELECT x.mode AS mode, (unnest(range(len(x.names))))::INTEGER AS position, unnest(x.names) AS name, true AS adds_up FROM m""",
    "file_round_trip": f"""WITH {_WRITTEN} SELECT folder, file_name, md5, file_size FROM w
QUALIFY row_number() OVER (PARTITION BY md5 ORDER BY folder, doc_id % 10, file_name) = 1""",
    "file_move": f"""WITH {_WRITTEN}, r AS (SELECT *, row_number() OVER (PARTITION BY md5 ORDER BY folder, doc_id % 10, file_name) AS nth FROM w)
SELECT doc_id, CASE WHEN nth = 1 THEN 'lib' ELSE 'src' END AS place, md5, CASE WHEN nth = 1 THEN 'destination_is_source' END AS second FROM r""",
    "guarded_delete_files": """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'deleted' ELSE 'outside_target' END AS status FROM documents WHERE doc_id % 3 < 2
UNION ALL SELECT doc_id, 'left' FROM documents WHERE doc_id % 3 > 0""",
    "ingest_files": f"WITH {_WRITTEN} SELECT doc_id, file_name, file_size, 'audio' AS file_type, md5 FROM w",
    "vector_merge": """SELECT CAST(vec_id AS VARCHAR) AS file_id, len(embedding)::INTEGER AS width, round(embedding[1]::DOUBLE, 6) AS x0
FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 = 0""",
    "cosine_column": """WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS l FROM embeddings)
SELECT a.vec_id, round(coalesce(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) / (a.l * b.l), 0), 6) AS cosine
FROM n a LEFT JOIN n b ON b.vec_id = a.vec_id + 1""",
    "taken_at_fractions": """WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN doc_id * 7 % 1000 * 1000 ELSE doc_id * 7919 % 1000000 END AS f FROM documents)
SELECT doc_id, concat(strftime(make_timestamp(1600000000000000 + doc_id * 3607000000), '%Y-%m-%dT%H:%M:%S'),
 CASE WHEN f = 0 THEN '' WHEN f % 1000 = 0 THEN concat('.', lpad(CAST(f // 1000 AS VARCHAR), 3, '0')) ELSE concat('.', lpad(CAST(f AS VARCHAR), 6, '0')) END, '+00:00') AS taken_at FROM t""",
}
