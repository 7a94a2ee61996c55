"""Jobs on real files in temporary folders: listing, hashing, scanning, organizing, deleting, ingest."""

import hashlib
import os
import random
import struct
import sys
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from checks import file_queries
from pixelkin.operators import catalog
from pixelkin.plans import dedup, deletes, flows, organize
from pixelkin.plans.scan import scan
from pixelkin.schemas import FILES, GROUPS, VECTORS
from pixelkin.session import materialize
from pixelkin.sources import exif, listing, media, tasks
from pixelkin.streaming.ingest import ingest


# Tasks cannot import a test module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def png(pixels) -> bytes:
    height, width = pixels.shape[:2]
    raw = b"".join(b"\x00" + row.tobytes() for row in pixels)

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    colour = 2 if pixels.ndim == 3 else 0
    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def picture(seed: int, side=72):
    cells = np.random.default_rng(seed).integers(0, 255, (8, 9, 3), np.uint8)
    return np.repeat(np.repeat(cells, side // 8, 0), side // 8, 1)


def jpeg_head(date: bytes) -> bytes:
    """A JPEG start with one date in the embedded directory."""
    tiff = b"II*\x00\x08\x00\x00\x00" + struct.pack("<HHHII", 1, 0x8769, 4, 1, 26) + b"\x00" * 4
    tiff += struct.pack("<HHHII", 1, 0x9003, 2, len(date) + 1, 44) + b"\x00" * 4 + date + b"\x00"
    body = b"Exif\x00\x00" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xd9"


def decode(path):
    """Decoder for the plain PNG files of these tests."""
    data = open(path, "rb").read()
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    width, height = struct.unpack(">II", data[16:24])
    at, packed = 8, b""
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        packed += data[at + 8 : at + 8 + size] if kind == b"IDAT" else b""
        at += 12 + size
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * 3)[:, 1:].reshape(height, width, 3)


@pytest.fixture()
def folder(tmp_path):
    deep = tmp_path / "src" / "a" / "b"
    deep.mkdir(parents=True)
    (tmp_path / "src" / "one.PNG").write_bytes(png(picture(1)))
    (deep / "one copy.png").write_bytes(png(picture(1)))
    (deep / "_two.png").write_bytes(png(picture(2)))
    (tmp_path / "src" / "a" / "broken.jpg").write_bytes(b"not a picture")
    (tmp_path / "src" / "a" / "dated.jpg").write_bytes(jpeg_head(b"2019:07:08 09:10:11"))
    (tmp_path / "src" / "a" / "song.mp3").write_bytes(b"la la")
    (tmp_path / "src" / "notes.txt").write_text("no media")
    os.symlink(tmp_path / "src", tmp_path / "src" / "a" / "loop")
    return tmp_path


def test_listing(spark, folder):
    src = str(folder / "src")
    rows = listing.list_media(spark, [src, src + "/a", str(folder / "missing")]).collect()
    assert sorted(r.file_name for r in rows) == sorted(
        ["one.PNG", "one copy.png", "_two.png", "broken.jpg", "dated.jpg", "song.mp3"]
        + ["one copy.png", "_two.png", "broken.jpg", "dated.jpg", "song.mp3"]
    )
    assert catalog.scan_summary(listing.list_media(spark, [src])).first().asDict() == {
        "total_files": 6, "images": 5, "videos": 0, "audios": 1,
    }
    roots = spark.createDataFrame([("p", src, 1), ("q", "/nowhere", 2)], "project_id string, path string, created_at int")
    assert listing.list_roots(spark, roots, "p").count() == 6


def test_exif():
    assert exif.raw_dates(jpeg_head(b"2019:07:08 09:10:11")) == ["2019:07:08 09:10:11"]
    assert exif.raw_dates(b"\xff\xd8\xff\xe1") == [] and exif.raw_dates(b"") == []


def test_scan_and_rescan(spark, folder):
    src = str(folder / "src")
    table = str(folder / "files")
    empty = catalog.read_table(spark, table, FILES)
    rows, summary = scan(spark, [src], empty, "p", decode)
    got = {r.file_name: r for r in rows.collect()}
    assert summary.first().total_files == 6 and len(got) == 6
    assert got["one.PNG"].phash == got["one copy.png"].phash is not None
    assert got["one.PNG"].phash == media.pixel_hash(media._grey(picture(1)))
    assert got["_two.png"].phash != got["one.PNG"].phash
    assert got["broken.jpg"].phash is None and got["song.mp3"].phash is None
    assert got["dated.jpg"].taken_at == "2019-07-08T09:10:11"
    assert got["song.mp3"].md5 == hashlib.md5(b"la la").hexdigest()
    assert got["song.mp3"].taken_at.endswith("+00:00")
    catalog.store_files(rows, table)
    again, summary = scan(spark, [src], catalog.read_table(spark, table, FILES), "p", decode)
    assert again.count() == 0 and summary.first().total_files == 6


def test_spark_image_source_agrees(spark, folder):
    os.unlink(folder / "src" / "a" / "loop")
    hashes = {r.path.rsplit("/", 1)[1]: r.phash for r in media.image_hashes(media.spark_images(spark, [str(folder / "src" / "a" / "b"), str(folder / "src")])).collect()}
    assert hashes["one.PNG"] == hashes["one copy.png"] == media.pixel_hash(media._grey(picture(1)))
    assert hashes["broken.jpg"] is None
    rows, _ = scan(spark, [str(folder / "src")], spark.createDataFrame([], FILES), "p")
    assert {r.file_name: r.phash for r in rows.collect()}["one.PNG"] == hashes["one.PNG"]


def test_organize_copy_then_move(spark, folder):
    src, target = str(folder / "src"), str(folder / "out")
    rows, _ = scan(spark, [src], spark.createDataFrame([], FILES), "p", decode)
    disk = listing.list_media(spark, [src])
    plan = organize.organize_plan(rows, disk, target, "YYYY")
    done = organize.execute_organize(plan)
    assert organize.organize_summary(done).first().asDict() == {"total": 6, "success": 5, "skipped": 1}
    assert os.path.exists(target + "/2019/dated.jpg") and os.path.exists(src + "/a/dated.jpg")
    held, _ = scan(spark, [target], rows, "p", decode)
    both = rows.unionByName(held)
    disk = listing.list_media(spark, [src, target])
    second = organize.organize_plan(both, disk, target, "YYYY", "move")
    assert {r.skip_reason for r in second.collect()} == {organize.SKIP_CONTENT}
    os.remove(target + "/2019/dated.jpg")
    third = organize.organize_plan(both, listing.list_media(spark, [src, target]), target, "YYYY", "move")
    moved = organize.execute_organize(third)
    assert [r.path for r in moved.where("status = 'success'").collect()] == [src + "/a/dated.jpg"]
    assert os.path.exists(target + "/2019/dated.jpg") and not os.path.exists(src + "/a/dated.jpg")
    gone = catalog.stale_rows(both, listing.list_media(spark, [src]), "p", target)
    assert gone.count() == held.count()


def test_organize_never_overwrites(spark, folder):
    """A stale listing, a destination of other content, one of our own from before, and a repeated run."""
    src, target = str(folder / "src"), folder / "out"
    rows, _ = scan(spark, [src], spark.createDataFrame([], FILES), "p", decode)
    plan = organize.organize_plan(rows, listing.list_media(spark, [src]), str(target), "YYYY")
    (target / "2019").mkdir(parents=True)
    (target / "2019" / "dated.jpg").write_bytes(b"precious")
    planned = {r.path: r.dest_path for r in plan.collect()}
    song = planned[src + "/a/song.mp3"]
    os.makedirs(os.path.dirname(song), exist_ok=True)
    with open(song, "wb") as out:
        out.write(b"la la")
    for _ in range(2):
        status = {r.path: (r.status, r.skip_reason) for r in organize.execute_organize(plan).collect()}
        assert status[src + "/a/dated.jpg"] == (organize.FAILED, organize.DEST_EXISTS)
        assert status[src + "/a/song.mp3"] == (organize.DONE, None)
        assert (target / "2019" / "dated.jpg").read_bytes() == b"precious"
    assert not [n for _, _, names in os.walk(target) for n in names if n.endswith(".part")]
    moved = organize.execute_organize(plan.withColumn("action", F.lit("move")))
    assert os.path.exists(src + "/a/dated.jpg") and not os.path.exists(src + "/a/song.mp3")
    assert moved.where("status = 'failed'").count() == 1


def test_a_move_onto_itself_keeps_the_file(tmp_path):
    (tmp_path / "lib").mkdir()
    (tmp_path / "other").symlink_to(tmp_path / "lib")
    cases = {"odd": "lib//odd.jpg", "dot": "lib/./dot.jpg", "up": "lib/../lib/up.jpg", "folder": "other/folder.jpg"}
    for name, dest in cases.items():
        file = tmp_path / "lib" / f"{name}.jpg"
        file.write_bytes(name.encode())
        assert organize._transfer(str(file), f"{tmp_path}/{dest}", True) == organize.DEST_IS_SOURCE
        assert file.read_bytes() == name.encode()
    # Links: the destination leads to the source, the source to the destination, and to a third file of equal content.
    source = tmp_path / "a.jpg"
    source.write_bytes(b"only")
    (tmp_path / "lib" / "a.jpg").symlink_to(source)
    assert organize._transfer(str(source), f"{tmp_path}/lib/a.jpg", True) == organize.DEST_IS_SOURCE
    assert organize._transfer(f"{tmp_path}/lib/a.jpg", str(source), True) == organize.DEST_IS_SOURCE
    assert source.read_bytes() == b"only"
    (tmp_path / "third.jpg").write_bytes(b"only")
    (tmp_path / "lib" / "b.jpg").symlink_to(tmp_path / "third.jpg")
    assert organize._transfer(str(source), f"{tmp_path}/lib/b.jpg", True) == organize.DEST_EXISTS
    # A second hard name may stay alone: the content is still there under it.
    os.link(source, tmp_path / "lib" / "c.jpg")
    assert organize._transfer(str(source), f"{tmp_path}/lib/c.jpg", True) is None
    assert (tmp_path / "lib" / "c.jpg").read_bytes() == b"only" and not source.exists()
    # A source that is a link moves as a file of its own.
    (tmp_path / "d.jpg").symlink_to(tmp_path / "third.jpg")
    assert organize._transfer(f"{tmp_path}/d.jpg", f"{tmp_path}/lib/d.jpg", True) is None
    assert not (tmp_path / "lib" / "d.jpg").is_symlink() and (tmp_path / "third.jpg").exists()


def test_names_are_free_whatever_exists(spark):
    """The first names that a conflict would get are all taken on disk."""
    wanted = [("/a/x.jpg", None, "/t", "x.jpg"), ("/b/x.jpg", None, "/t", "x.jpg")]
    digest = lambda text: hashlib.md5(text.encode()).hexdigest()
    disk = ["/t/x.jpg"]
    for path, *_ in wanted:
        disk += [f"/t/x_{digest(path)[:6]}.jpg", f"/t/x_{digest(path)}.jpg", f"/t/x_{digest(path + ':1')}.jpg"]
    rows = spark.createDataFrame(wanted, "path string, taken_at string, dest_dir string, file_name string")
    found = organize.resolve_conflicts(rows, spark.createDataFrame([(d,) for d in disk], "path string")).collect()
    names = {r.dest_path for r in found}
    assert len(names) == 2 and names.isdisjoint(disk)


def test_links_that_lead_back(spark, tmp_path):
    """A root that is a link itself, and two folders that link to each other."""
    (tmp_path / "real" / "a").mkdir(parents=True)
    (tmp_path / "real" / "b").mkdir()
    (tmp_path / "real" / "one.jpg").write_bytes(b"1")
    os.symlink(tmp_path / "real", tmp_path / "root")
    os.symlink(tmp_path / "root", tmp_path / "real" / "a" / "up")
    os.symlink(tmp_path / "real" / "a", tmp_path / "real" / "b" / "x")
    os.symlink(tmp_path / "real" / "b", tmp_path / "real" / "a" / "y")
    paths = [r.path for r in listing.list_media(spark, [str(tmp_path / "root")]).collect()]
    assert paths == [str(tmp_path / "root" / "one.jpg")]


def test_guarded_delete(spark, folder):
    src = str(folder / "src")
    doomed = [(src + "/one.PNG",), (src + "/never.png",), (str(folder / "src2" / "x.png"),)]
    frame = spark.createDataFrame(doomed, "path string")
    dry = {r.path: r.status for r in deletes.execute_deletes(frame, src).collect()}
    assert dry[src + "/one.PNG"] == deletes.WOULD_DELETE and os.path.exists(src + "/one.PNG")
    status = deletes.execute_deletes(frame, src, dry_run=False)
    assert [r.status for r in status.orderBy("path").collect()] == [deletes.ABSENT, deletes.DELETED, deletes.OUTSIDE]
    assert not os.path.exists(src + "/one.PNG")
    upwards = spark.createDataFrame([(src + "/../src/a/song.mp3",), (src + "/..",)], "path string")
    assert {r.status for r in deletes.execute_deletes(upwards, src, dry_run=False).collect()} == {deletes.OUTSIDE}
    assert [r.path for r in deletes.catalog_after_deletes(frame, status).collect()] == [doomed[2][0]]


def test_embedding_fills_the_cache(spark, folder):
    src, cache = str(folder / "src"), str(folder / "vectors")
    rows, _ = scan(spark, [src], spark.createDataFrame([], FILES), "p", decode)

    def load():
        return lambda array: array[0, :, ::56, ::56].ravel() + 3.0

    stored = catalog.read_table(spark, cache, VECTORS)
    run = dedup.dedup(rows, stored, "ai", embedder=media.embedder(load, decode))
    assert run.summary.first().groups_found >= 1
    assert run.new_vectors.count() == 3
    norms = [sum(x * x for x in r.vector) for r in run.new_vectors.collect()]
    assert all(abs(n - 1) < 1e-5 for n in norms)
    catalog.store_vectors(run.new_vectors, stored, cache)
    catalog.store_vectors(run.new_vectors, catalog.read_table(spark, cache, VECTORS), cache)
    assert catalog.read_table(spark, cache, VECTORS).count() == 3
    groups = str(folder / "groups")
    catalog.store_groups(run.groups, "p", groups)
    catalog.store_groups(run.groups.limit(0), "q", groups)
    assert catalog.read_table(spark, groups, GROUPS).count() == run.groups.count()
    catalog.store_groups(run.groups.where(F.lit(False)), "p", groups)
    assert catalog.read_table(spark, groups, GROUPS).count() == 0


def test_model_input():
    flat = media.model_input(np.full((10, 20, 3), 255, np.uint8))
    assert flat.shape == (1, 3, 224, 224)
    assert np.allclose(flat[0, :, 5, 5], [(1 - m) / s for m, s in zip(media.CHANNEL_MEAN, media.CHANNEL_STD)])
    assert media.unit_vector([]) is None and media.unit_vector([0.0, 0.0]).tolist() == [0.0, 0.0]


def test_ingest_takes_each_file_once(spark, folder):
    # Spark's own source would follow the link round and round.
    os.unlink(folder / "src" / "a" / "loop")
    src, table, mark = str(folder / "src"), str(folder / "cat"), str(folder / "mark")
    for expected in (5, 5, 6):
        ingest(spark, src, table, mark, "p", decode).awaitTermination()
        rows = catalog.read_table(spark, table, FILES)
        assert rows.count() == expected == rows.select("path").distinct().count()
        if expected == 5 and not os.path.exists(src + "/later.png"):
            if os.path.exists(str(folder / "once")):
                (folder / "src" / "later.png").write_bytes(png(picture(9)))
            (folder / "once").write_text("")


def test_ingest_lists_in_tasks(spark, folder):
    # What the stream reads and remembers are files of its log, not the files of the folder.
    src, table, mark = folder / "src", str(folder / "cat"), folder / "mark"
    for name in (".hidden.mp3", "_skipped.mp3", "_k=1.mp3", "plain name+%20.mp3"):
        (src / "a" / name).write_bytes(b"x")
    (src / "a" / "empty.mp3").write_bytes(b"")
    (src / ".cache").mkdir()
    (src / ".cache" / "seen.mp3").write_bytes(b"x")
    for k in range(60):
        (src / "a" / f"song{k}.mp3").write_bytes(bytes([k]))
    ingest(spark, str(src), table, str(mark), "p", decode).awaitTermination()
    rows = {r.path: r for r in catalog.read_table(spark, table, FILES).collect()}
    names = {r.file_name for r in rows.values()}
    assert {"_k=1.mp3", "plain name+%20.mp3", "song59.mp3"} <= names
    assert not names & {".hidden.mp3", "_skipped.mp3", "seen.mp3", "_two.png", "empty.mp3"}
    for r in rows.values():
        assert r.md5 == hashlib.md5(open(r.path, "rb").read()).hexdigest() and r.file_size == os.path.getsize(r.path)
    remembered = "".join(p.read_text() for p in (mark / "sources").rglob("*") if p.is_file() and not p.name.startswith("."))
    assert "part-" in remembered and "song" not in remembered
    assert spark.read.parquet(str(mark / "listed")).count() == len(rows) + 1
    # A new file is taken, whatever its age.
    old = src / "a" / "old.mp3"
    old.write_bytes(b"old")
    os.utime(old, (10**9, 10**9 + 0.123456))
    ingest(spark, str(src), table, str(mark), "p", decode).awaitTermination()
    stored = catalog.read_table(spark, table, FILES)
    assert stored.count() == len(rows) + 1
    assert stored.where("file_name = 'old.mp3'").first().taken_at == "2001-09-09T01:46:40.123+00:00"
    with pytest.raises(FileNotFoundError):
        ingest(spark, str(folder / "none"), table, str(folder / "other"), "p", decode)


def test_tasks_are_cut_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(tasks, "GROUP_FILES", 300)
    rng = random.Random(3)
    sizes = [rng.choice([0, 10, 1000, 1 << 20, 40 << 20]) for _ in range(1000)] + [300 << 20, 5 << 30, None]
    rows = [(f"/f{k}", s) for k, s in enumerate(sizes)]
    files = materialize(spark.createDataFrame(rows, "path string, file_size long").repartition(3), "sized")
    placed = tasks.in_even_tasks(files).withColumn("part", F.spark_partition_id()).collect()
    assert sorted((r.path, r.file_size or 0) for r in placed) == sorted((p, s or 0) for p, s in rows)
    of = {}
    for r in placed:
        of.setdefault(r.part, []).append((r.file_size or 0) + tasks.OPEN_BYTES)
    total = sum(map(sum, of.values()))
    for costs in of.values():
        assert len(costs) == 1 or max(costs) < tasks.TASK_BYTES
        assert len(costs) == 1 or sum(costs) < tasks.TASK_BYTES + max(costs)
    # Few tasks more than the bytes ask for: one unfinished task for each group.
    assert len(of) <= total // tasks.TASK_BYTES + 2 * 4 + 2
    assert tasks.in_even_tasks(files.limit(0)).count() == 0
    assert tasks.in_even_tasks(files.select("path")).count() == len(rows)


@pytest.mark.parametrize("dies_at", ["write", "aside", "place", "delete", None])
def test_a_killed_replacement_leaves_a_readable_table(spark, tmp_path, monkeypatch, dies_at):
    path = str(tmp_path / "groups")
    old = spark.createDataFrame([("a", "g"), ("b", "g")], "file_id string, group_id string")
    new = spark.createDataFrame([("a", "h"), ("c", "h")], "file_id string, group_id string")
    catalog.store_groups(old, "p", path)
    catalog.store_groups(old, "q", path)

    real = catalog._file_system

    class Dying:
        def __init__(self, system):
            self.system, self.renames = system, 0

        def rename(self, *a):
            self.renames += 1
            if self.renames == {"aside": 1, "place": 2}.get(dies_at):
                raise KeyboardInterrupt
            return self.system.rename(*a)

        def delete(self, *a):
            if dies_at == "delete":
                raise KeyboardInterrupt
            return self.system.delete(*a)

        def __getattr__(self, name):
            if dies_at == "write":
                raise KeyboardInterrupt
            return getattr(self.system, name)

    made = []

    def dying(session, at):
        system, paths = real(session, at)
        made.append(Dying(system))
        return made[0], paths

    if dies_at:
        monkeypatch.setattr(catalog, "_file_system", dying)
        with pytest.raises(KeyboardInterrupt):
            catalog.store_groups(new, "p", path)
        monkeypatch.setattr(catalog, "_file_system", real)
    else:
        catalog.store_groups(new, "p", path)
    rows = {(r.project_id, r.file_id, r.group_id) for r in catalog.read_table(spark, path, GROUPS).collect()}
    kept = old if dies_at in ("write", "aside", "place") else new
    assert rows == {("q", "a", "g"), ("q", "b", "g")} | {("p", r.file_id, r.group_id) for r in kept.collect()}
    # The next replacement works on what is there.
    catalog.store_groups(old.limit(0), "p", path)
    assert {r.project_id for r in catalog.read_table(spark, path, GROUPS).collect()} == {"q"}


def test_rows_below_closed_folders(spark):
    rows = spark.createDataFrame([("/a/x/1",), ("/a/xy/2",), ("/a/x/d/3",), ("/b/4",)], "path string")
    closed = spark.createDataFrame([("/a/x",), ("/c",)], "path string")
    assert {r.path for r in catalog.outside_folders(rows, closed).collect()} == {"/a/xy/2", "/b/4"}


def test_a_closed_folder_is_reported_and_its_files_are_kept(spark, folder, monkeypatch):
    rows, _ = scan(spark, [str(folder / "src")], spark.createDataFrame([], FILES), "p", decode)
    store = flows.Store(str(folder / "tables"))
    catalog.store_files(rows, store.path("files"))
    before = {r.path for r in store.files(spark).collect()}
    gone = next(p for p in sorted(before) if os.path.dirname(p) == str(folder / "src"))
    os.remove(gone)
    if os.geteuid() == 0:
        # Nothing is closed to root: the listing says so instead.
        real = flows.list_media_and_closed
        shut = str(folder / "src" / "a")

        def closed(session, roots):
            found, _ = real(session, roots)
            return found.where(~F.col("path").startswith(shut + "/")), session.createDataFrame([(shut,)], "path string")

        monkeypatch.setattr(flows, "list_media_and_closed", closed)
    else:
        os.chmod(folder / "src" / "a", 0)
    told = flows._drop_stale(spark, store, "p", str(folder / "src"))
    assert [r.path for r in told.collect()] == [str(folder / "src" / "a")]
    assert {r.path for r in store.files(spark).collect()} == before - {gone}


def test_only_new_images_are_decoded(spark, folder, monkeypatch):
    asked = []
    real = media.spark_images
    monkeypatch.setattr(media, "spark_images", lambda session, paths: asked.extend(paths) or real(session, paths))
    os.unlink(folder / "src" / "a" / "loop")
    src = str(folder / "src")
    rows, _ = scan(spark, [src], spark.createDataFrame([], FILES), "p")
    # All but the hidden one.
    assert len(asked) == rows.where("file_type = 'image'").count() - 1
    asked.clear()
    odd = folder / "src" / "a" / "new [1] {x} *.png"
    odd.write_bytes((folder / "src" / "one.PNG").read_bytes())
    fresh, _ = scan(spark, [src], rows, "p")
    assert len(asked) == 1
    assert [(r.path, r.phash) for r in fresh.collect()] == [(str(odd), {r.file_name: r.phash for r in rows.collect()}["one.PNG"])]


def test_texts_are_written_one_after_the_other(tmp_path):
    """A batch of texts is never held a second time as Python objects."""
    size, names = 200_000, [f"{tmp_path}/{k % 3}/{k}.mp3" for k in range(64)]
    batch = pa.RecordBatch.from_pydict({"path": names, "text": ["é" * (size // 2)] * 63 + [None]})
    tracemalloc.start()
    try:
        done = [p for b in file_queries._write([batch]) for p in b.column("path").to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert done == names and peak < 8 * size
    assert [os.path.getsize(n) for n in names] == [size] * 63 + [0]
