"""File access inside tasks, for local paths and for any URI that Arrow knows."""

from __future__ import annotations

import hashlib
import os
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame

#: Files that one task handles.
TASK_FILES = 500


def spread(rows: DataFrame) -> DataFrame:
    """A stored table of files, dealt out so that each task has a bounded number of them."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(cores, -(-rows.count() // TASK_FILES)))


def locate(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and "://" not in path:
        return fs.LocalFileSystem(), path[len("file:") :]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def exists(path: str) -> bool:
    system, inner = locate(path)
    return system.get_file_info(inner).type != fs.FileType.NotFound


def same_place(a: str, b: str) -> bool:
    """Whether two paths lead to one directory entry, through links, odd slashes and dots."""
    (one, left), (other, right) = locate(a), locate(b)
    if isinstance(one, fs.LocalFileSystem) and isinstance(other, fs.LocalFileSystem):
        return os.path.realpath(left) == os.path.realpath(right)
    return one == other and os.path.normpath(left) == os.path.normpath(right)


def is_link(path: str) -> bool:
    system, inner = locate(path)
    return isinstance(system, fs.LocalFileSystem) and os.path.islink(inner)


def remove(path: str) -> None:
    system, inner = locate(path)
    system.delete_file(inner)


def copy(source: str, dest: str) -> None:
    src_fs, src = locate(source)
    dst_fs, dst = locate(dest)
    if src_fs == dst_fs:
        src_fs.copy_file(src, dst)
        return
    with src_fs.open_input_stream(src) as reader, dst_fs.open_output_stream(dst) as writer:
        while chunk := reader.read(1 << 20):
            writer.write(chunk)


def same_content(a: str, b: str) -> bool:
    """Whether two files have equal size and MD5."""
    return _size(a) == _size(b) and _md5(a) == _md5(b)


def _size(path: str) -> int:
    system, inner = locate(path)
    return system.get_file_info(inner).size


def _md5(path: str) -> str:
    digest = hashlib.md5()
    with open_stream(path) as reader:
        while chunk := reader.read(1 << 20):
            digest.update(chunk)
    return digest.hexdigest()


def place(source: str, dest: str, link: bool = False) -> None:
    """Copy ``source`` to ``dest``, which must not exist; raises FileExistsError and leaves ``dest`` alone otherwise.

    With ``link`` a second name will do where one disk holds both.

    The copy is made under a name of its own first. On a local disk it then takes its place as a link, which the system
    refuses when the name is taken; elsewhere the name is looked up just before.
    """
    system, inner = locate(dest)
    if exists(dest):
        raise FileExistsError(dest)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    own, path = locate(source)
    if link and isinstance(system, fs.LocalFileSystem) and isinstance(own, fs.LocalFileSystem):
        try:
            os.link(path, inner)
            return
        except FileExistsError:
            raise
        except OSError:
            pass  # Other volume, or no links: copy.
    part = f".{uuid.uuid4().hex}.part"
    copy(source, dest + part)
    try:
        if isinstance(system, fs.LocalFileSystem):
            os.link(inner + part, inner)
        elif exists(dest):
            raise FileExistsError(dest)
        else:
            system.move(inner + part, inner)
            return
    except BaseException:
        system.delete_file(inner + part)
        raise
    system.delete_file(inner + part)


def open_stream(path: str):
    system, inner = locate(path)
    return system.open_input_stream(inner)
