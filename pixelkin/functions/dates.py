"""Capture date expressions. Dates stay text, exactly as catalogued."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The folder templates offered to users, and the date that cameras write for "not set".
TEMPLATES = ["YYYY/MM/DD", "YYYY/MM", "YYYY_MM", "YYYY-MM/DD", "YYYY_MM/DD", "YYYY/YYYY-MM-DD", "YYYY"]
UNSET_EXIF_DATE = "0000:00:00 00:00:00"


def normalize_exif_date(raw: Column) -> Column:
    """``2021:03:04 05:06:07`` to ``2021-03-04T05:06:07``: two colons and one space, first come."""
    dashed = F.regexp_replace(raw, r"^([^:]*):([^:]*):", "$1-$2-")
    # A text with a single colon has only that one replaced.
    dashed = F.when(F.length(raw) - F.length(F.translate(raw, ":", "")) == 1, F.translate(raw, ":", "-")).otherwise(
        dashed
    )
    return F.regexp_replace(dashed, r"^([^ ]*) ", "$1T")


def usable_exif_date(raw: Column) -> Column:
    """Trimmed raw date, or null when empty or unset."""
    text = F.trim(raw)
    return F.when((text != "") & (text != UNSET_EXIF_DATE), text)


def rfc3339(moment: Column) -> Column:
    """UTC text of a timestamp with its fraction, in as few groups of three digits as it takes; needs a UTC session."""
    micros = F.pmod(F.unix_micros(moment), F.lit(1_000_000))
    fraction = (
        F.when(micros == 0, "")
        .when(micros % 1000 == 0, F.concat(F.lit("."), F.lpad((micros / 1000).cast("int").cast("string"), 3, "0")))
        .otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    )
    return F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))


def taken_at(file_type: Column, exif: Column, modified_at: Column) -> Column:
    """Images take their embedded date first; everything falls back to the file time."""
    embedded = F.when(file_type == "image", normalize_exif_date(usable_exif_date(exif)))
    return F.coalesce(embedded, rfc3339(modified_at))


def date_parts(taken: Column) -> Column:
    """Struct of year, month and day texts; null when the date has fewer than three parts."""
    day = F.split_part(F.split_part(taken, F.lit("T"), F.lit(1)), F.lit(" "), F.lit(1))
    parts = F.split(day, "-")
    return F.when(
        F.size(parts) >= 3,
        F.struct(parts[0].alias("year"), parts[1].alias("month"), parts[2].alias("day")),
    )


def apply_template(template: str | Column, parts: Column) -> Column:
    """Fill ``YYYY``, then ``MM``, then ``DD``, every occurrence."""
    text = F.lit(template) if isinstance(template, str) else template
    for mark, field in (("YYYY", "year"), ("MM", "month"), ("DD", "day")):
        text = F.replace(text, F.lit(mark), parts[field])
    return text
