"""Path, file type and folder expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The file extensions that make a file an image, a video or an audio file.
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "heic", "webp", "bmp", "tiff", "tif"]
VIDEO_EXTENSIONS = ["mp4", "mov", "avi", "mkv", "wmv", "flv", "webm"]
AUDIO_EXTENSIONS = ["mp3", "wav", "flac", "aac", "ogg", "wma", "m4a"]


def _forward(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def file_name(path: Column) -> Column:
    """Last path component; ``unknown`` for a path without one."""
    last = F.element_at(F.split(path, "/"), -1)
    return F.when(last.isNull() | (last == ""), F.lit("unknown")).otherwise(last)


def extension(path: Column) -> Column:
    """Lower-cased text after the last dot of the file name; empty when the name has none.

    A name whose only dot is its first character has no extension.
    """
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def file_stem(name: Column) -> Column:
    """File name without its extension."""
    return F.regexp_replace(name, r"(?<=[^/])\.[^./]*$", "")


def classify_extension(path: Column) -> Column:
    """``image``, ``video``, ``audio`` or null by the extension, ignoring case."""
    ext = extension(path)
    return (
        F.when(ext.isin(IMAGE_EXTENSIONS), F.lit("image"))
        .when(ext.isin(VIDEO_EXTENSIONS), F.lit("video"))
        .when(ext.isin(AUDIO_EXTENSIONS), F.lit("audio"))
    )


def path_key(path: Column) -> Column:
    """Comparison key of a path: forward slashes, lower case."""
    return F.lower(_forward(path))


def under_dir(path: Column, folder: str | Column, boundary: bool = False, ignore_case: bool = False) -> Column:
    """Is ``path`` below ``folder``?

    The default is a plain prefix test, so ``/a/b`` also covers ``/a/b2/x``. ``boundary=True`` demands
    that the folder name ends there; deletes use it.
    """
    base = _forward(F.lit(folder) if isinstance(folder, str) else folder)
    full = _forward(path)
    if ignore_case:
        base, full = F.lower(base), F.lower(full)
    if boundary:
        base = F.concat(F.rtrim(base, F.lit("/")), F.lit("/"))
    return F.startswith(full, base)


def relative_folder(path: Column, target: str) -> Column:
    """Folder of ``path`` relative to ``target``; ``/`` for the target itself; the full folder elsewhere."""
    base = target.replace("\\", "/")
    base = base[:-1] if base.endswith("/") else base
    full = F.regexp_replace(_forward(path), "/$", "")
    folder = F.when(F.instr(full, "/") > 0, F.regexp_replace(full, "/[^/]*$", "")).otherwise(F.lit(""))
    inside = F.regexp_replace(F.substring(folder, len(base) + 1, 1 << 30), "^/", "")
    return F.when(
        F.startswith(folder, F.lit(base)), F.when(inside == "", F.lit("/")).otherwise(inside)
    ).otherwise(folder)


def of_types(file_type: Column, wanted: list[str] | None) -> Column:
    """Row filter on file types; an empty list keeps everything."""
    return file_type.isin(wanted) if wanted else F.lit(True)
