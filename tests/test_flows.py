"""The three flows on real folders; a second run changes nothing."""

import os

from test_files import decode, picture, png

from pixelkin.operators import catalog
from pixelkin.plans import deletes, flows, organize
from pixelkin.schemas import GROUPS
from pixelkin.sources import media


def tree(tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for k, seed in enumerate((1, 1, 2, 3)):
        pixels = picture(seed)
        pixels[0, 0, 0] ^= k  # Like the other, but not byte for byte.
        (src / f"p{k}.png").write_bytes(png(pixels))
        os.utime(src / f"p{k}.png", (1_500_000_000 + k * 86_400,) * 2)
    return str(src), str(tmp_path / "lib"), flows.Store(str(tmp_path / "store"))


def names(folder):
    return sorted(f for _, _, found in os.walk(folder) for f in found)


def test_organize_find_delete(spark, tmp_path):
    src, lib, store = tree(tmp_path)
    first = flows.organize_project(spark, store, "p", [src], lib, "YYYY/MM/DD", decoder=decode)
    assert organize.organize_summary(first).first().success == 4 and len(names(lib)) == 4

    load = lambda: lambda array: array[0, :, ::56, ::56].ravel() + 3.0
    runs = [
        flows.find_duplicates(spark, store, "p", lib, "phash_ai", decoder=decode, embedder=media.embedder(load, decode))
        for _ in range(2)
    ]
    for run in runs:
        stages = [r["name"] for r in run.timings.collect()]
        assert stages[0] == "scan" and stages[-1] == "total"
        assert run.summary.first().groups_found == 1
    groups = catalog.read_table(spark, store.path("groups"), GROUPS)
    assert groups.count() == 2 and store.files(spark).count() == 8
    assert runs[0].new_vectors.count() > 0 and runs[1].new_vectors.count() == 0

    again = flows.organize_project(spark, store, "p", [src], lib, "YYYY/MM/DD", decoder=decode)
    assert {r.skip_reason for r in again.collect()} == {organize.SKIP_CONTENT} and len(names(lib)) == 4

    files = store.files(spark).join(groups.select("file_id"), "file_id")
    doomed = files.orderBy("path").limit(1).select("path")
    path = doomed.first().path
    status, removed = flows.delete_files(spark, store, doomed, lib)
    assert removed == 1 and status.first().status == deletes.DELETED and not os.path.exists(path)
    assert store.files(spark).count() == 7
    assert flows.delete_files(spark, store, spark.createDataFrame([(src + "/p0.png",)], "path string"), lib)[1] == 0
    assert len(names(src)) == 4

    os.remove(next(os.path.join(d, f) for d, _, found in os.walk(lib) for f in found))
    flows.find_duplicates(spark, store, "p", lib, "phash", decoder=decode)
    assert store.files(spark).count() == 6
