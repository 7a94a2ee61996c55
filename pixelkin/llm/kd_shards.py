"""K-d tree partitioning of rows by their metadata into leaves of near-equal bytes.

A node that holds more than its share is cut at a weighted median of its widest dimension: the value below which half of
its bytes lie (or the share of its smaller half, where the number of leaves is odd). Dimensions are numbers in the order of
their values; a node's widest is the one with the largest extent relative to the corpus. Rows of equal value are told
apart by the hash of their text, then by a number of their own, so equal texts stay side by side and a cut is exact to a
row even if one value holds a third of all rows.

Medians are found by histograms: all nodes of a level count the bytes of some hundred bins at once, the bin that crosses
the mark is split again. Rows stay where they are, only bin sums move, and a pass returns one row for each node.

Everything is DataFrame functions. Defined results: null text counts as size 1 with the CRC of the empty text; null
metadata sorts first; equal rows get slots of their own; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelkin.session import materialize

BINS = 512
_TOP = (1 << 63) - 1
_HASHES = (1 << 62) - 1


def text_rank(value: Column) -> Column:
    """A number that orders strings by their first seven bytes."""
    head = F.rpad(F.hex(F.substring(F.encode(F.coalesce(value, F.lit("")), "UTF-8"), 1, 7)), 14, "0")
    return F.conv(head, 16, 10).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, hash, dims, uid): one narrow row per document, stored with numbers of their own."""
    text = F.coalesce(F.col("text"), F.lit(""))
    dims = F.array(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-_TOP)),
        F.floor(F.log2(F.length(text) + 1.0) * 1024).cast("long"),
        text_rank(F.col("lang")),
        text_rank(F.col("source")),
    )
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 2).alias("hash"),
        dims.alias("dims"),
        F.monotonically_increasing_id().alias("uid"),
    )
    return materialize(narrow, "measured")


def _widest(rows: DataFrame, dims: int) -> DataFrame:
    """(node, bytes, dim): total and widest dimension of each node."""
    ends = [f(F.get("dims", F.lit(k)).cast("double")).alias(f"{n}{k}") for k in range(dims) for n, f in (("lo", F.min), ("hi", F.max))]
    return rows.groupBy("node").agg(F.sum("size").alias("bytes"), *ends)


def _medians(rows: DataFrame, marks: list[dict]) -> list[dict]:
    """For each mark (node, dim, target): the key up to which the node's bytes come nearest to the target.

    A key is (value, hash, uid); a part that no longer matters is at its top or below its bottom.
    """
    spark, done = rows.sparkSession, []
    state = [
        m | {"stage": 0, "value": 0, "tie": 0, "low": None, "high": None, "below": 0} for m in marks
    ]
    while state:
        known = spark.createDataFrame(
            [(s["node"], s["dim"], s["target"], s["stage"], s["value"], s["tie"], s["low"], s["high"], s["below"]) for s in state],
            "node long, dim int, target double, stage int, value long, tie long, low long, high long, below long",
        )
        # One row for each node that is being cut.
        near = rows.join(F.broadcast(known), "node")
        own = F.get("dims", F.col("dim"))
        key = F.when(F.col("stage") == 0, own).when(F.col("stage") == 1, F.col("hash")).otherwise(F.col("uid"))
        near = near.where((F.col("stage") < 1) | (own == F.col("value"))).where((F.col("stage") < 2) | (F.col("hash") == F.col("tie")))
        near = near.withColumn("key", key).where(
            F.col("low").isNull() | F.col("key").between(F.col("low"), F.col("high"))
        )
        # Without bounds the first pass bins by powers of two around zero.
        span = F.col("high").cast("double") - F.col("low")
        inside = F.floor((F.col("key").cast("double") - F.col("low")) / span * BINS)
        rough = F.signum(F.col("key").cast("double")) * F.floor(F.log2(F.abs(F.col("key").cast("double")) + 1) * 4)
        bins = near.withColumn("bin", F.when(F.col("low").isNull(), rough).when(span <= 0, 0).otherwise(inside).cast("long"))
        sums = bins.groupBy("node", "bin").agg(
            F.first("target").alias("target"), F.first("below").alias("below"),
            F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high"),
        )
        up_to = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("upper", F.col("below") + F.sum("bytes").over(up_to))
        crossing = sums.where((F.col("upper") >= F.col("target")) & (F.col("upper") - F.col("bytes") < F.col("target")))
        found = {r["node"]: r for r in crossing.collect()}
        pending = []
        for s in state:
            r = found[s["node"]]
            s |= {"low": r["low"], "high": r["high"], "below": r["upper"] - r["bytes"]}
            if s["low"] < s["high"]:
                pending.append(s)
                continue
            if s["stage"] == 2 or r["n"] == 1:
                takes = r["upper"] - s["target"] <= s["target"] - s["below"]
                cut = [s["low"] if s["stage"] == 0 else s["value"], s["low"] if s["stage"] == 1 else s["tie"], s["low"]]
                for part in range(s["stage"] + 1, 3):
                    cut[part] = _TOP if takes else -1
                if s["stage"] == 2 and not takes:
                    cut[2] -= 1
                done.append({"node": s["node"], "dim": s["dim"], "cut": cut})
                continue
            s["value" if s["stage"] == 0 else "tie"] = s["low"]
            s |= {"stage": s["stage"] + 1, "low": 0, "high": _HASHES if s["stage"] == 0 else _TOP}
            pending.append(s)
        state = pending
    return done


def kd_shards(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` (a frame from ``measured``) with its ``shard`` from 0 to ``shards`` - 1, of near-equal bytes."""
    spark = rows.sparkSession
    shares, names, extent = {1: shards}, {}, None
    rows = rows.withColumn("node", F.lit(1).cast("long"))
    dims = 4
    while any(share > 1 for share in shares.values()):
        stats = {r["node"]: r for r in _widest(rows, dims).collect()}
        marks = []
        for node, share in shares.items():
            if share < 2 or node not in stats:
                continue
            r = stats[node]
            width = [r[f"hi{k}"] - r[f"lo{k}"] for k in range(dims)]
            extent = extent or [w or 1.0 for w in width]
            dim = max(range(dims), key=lambda k: width[k] / extent[k])
            marks.append({"node": node, "dim": dim, "target": r["bytes"] * (share // 2) / share})
        if not marks:
            break
        cuts = _medians(rows, marks)
        known = spark.createDataFrame(
            [(c["node"], c["dim"], *c["cut"]) for c in cuts], "node long, dim int, value long, tie long, last long"
        )
        # One row for each node that is cut; there are fewer of them than shards.
        joined = rows.join(F.broadcast(known), "node", "left")
        own = F.struct(F.get("dims", F.col("dim")).alias("a"), F.col("hash").alias("b"), F.col("uid").alias("c"))
        mark = F.struct(F.col("value").alias("a"), F.col("tie").alias("b"), F.col("last").alias("c"))
        child = F.when(F.col("dim").isNull(), F.col("node")).otherwise(F.col("node") * 2 + F.when(own <= mark, 0).otherwise(1))
        rows = materialize(joined.withColumn("_child", child).select(*[c for c in rows.columns if c != "node"], F.col("_child").alias("node")), "nodes")
        cut_nodes = {c["node"] for c in cuts}
        shares = {
            child: part
            for node, share in shares.items()
            for child, part in (
                [(2 * node, share // 2), (2 * node + 1, share - share // 2)] if node in cut_nodes else [(node, 1)]
            )
        }
    # Leaves in the order of the tree: a node's number, read as a path from the root.
    depth = max(n.bit_length() for n in shares)
    names = {n: k for k, n in enumerate(sorted(shares, key=lambda n: n << (depth - n.bit_length())))}
    leaf = F.broadcast(spark.createDataFrame(list(names.items()), "node long, shard int"))
    return rows.join(leaf, "node").drop("node")


def with_slots(rows: DataFrame) -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 within each shard, in the order of ``uid``."""
    rows = rows.withColumn("part", F.shiftright("uid", 33))
    counts = materialize(rows.groupBy("shard", "part").agg(F.count("*").alias("here")), "slots")
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("here").over(earlier), F.lit(0))).drop("here")
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("uid")) - 1
    return rows.withColumn("nth", own).join(before, ["shard", "part"]).withColumn("slot", (F.col("before") + F.col("nth")).cast("long"))


def sharded(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of ``docs``."""
    return with_slots(kd_shards(measured(docs), shards)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
