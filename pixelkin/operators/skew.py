"""Lookup of per-key facts for rows whose keys may be very unevenly used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelkin.session import is_empty, materialize

# There are at most (rows / HOT_ROWS) keys above this count, a hundred thousand for 10^11 rows.
HOT_ROWS = 1_000_000
# Parts into which the rows of a hot key are dealt.
SALTS = 64


def keyed_join(
    rows: DataFrame, facts: DataFrame, key: str | list[str], count: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Inner join of ``rows`` with ``facts``, one row per key, whose ``count`` column tells its rows.

    Facts of keys above ``hot_rows`` are few by construction. They are stored, so that Spark knows their size and sends
    them to the rows only where it is small; beyond that, rows of hot keys are salted and meet copies of their facts. All
    other keys meet in a shuffled join. ``facts`` should be a stored table, since it is read more than once.
    """
    heavy = F.col(count) > hot_rows
    hot = materialize(facts.where(heavy), "hot-facts")
    if is_empty(hot):
        return rows.join(facts, key)
    names = [key] if isinstance(key, str) else list(key)
    copies = hot.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    spread = salted.join(copies, [*names, "_salt"]).drop("_salt")
    marked = salted.join(copies.select(*names, "_salt"), [*names, "_salt"], "left_anti").drop("_salt")
    return spread.unionByName(marked.join(facts.where(~heavy), key))
