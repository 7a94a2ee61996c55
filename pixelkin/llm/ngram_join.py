"""N-gram Jaccard join: exact set similarity of documents by a grouped prefix join.

A document's set holds its distinct five-word shingles. Documents with equal sets form one class. Shingles are
dealt out by hash; where one meets its classes, shingles of a single class drop out, the others keep the number
of classes. Ordered by that number, rarest first, two sets of 75 % likeness share a shingle of their prefixes (the
first n - ceil(0.75 n) + 1). Shingles of one class come first in that order, so few sets have a prefix left.

Classes with the same prefix and size collapse into one group. Groups meet at the shingles of their prefixes, but only
within sizes that likeness allows, and each is tied to one representative there instead of to all others, so a
shingle costs as many rows as it has groups. What hangs together is expanded to its classes and verified, all
against all, as bounded blocks of set products. Only spanning links and link counts leave a block.

Defined results: null or wordless text has an empty set (n_shingles 0), links with nothing and is its own
component; fewer than five words make one shingle of them all; equal rows and equal ids stay as they are;
a null id is kept, and its component is named by the smallest id that is not null; an empty table gives an empty
one; other columns are ignored, whatever their names.

Sets are compared as 64-bit hashes (40 bits and the block number once dealt out).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelkin.llm import arrow_text
from pixelkin.operators.components import components
from pixelkin.session import materialize

#: Characters of text whose shingles meet in one task, shingles that are sorted there at once, and characters of text whose
#: sets come home to one task. A document is named once in each block that it has shingles in, so blocks are large.
BLOCK_CHARS = 32_000_000
PART_SHINGLES = 1_500_000
HOME_CHARS = 8_000_000
#: Bounds of a verified block.
#: Bytes of text whose sets are dealt out at once.
DEALT_BYTES = 4 << 20
BLOCK_SETS = 256
BLOCK_SHINGLES = 1_000_000
_LOW = np.uint64((1 << 24) - 1)


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """(row, distinct shingle hashes, hash of the set) of every row of a text column."""
    data, offsets = arrow_text.utf8(column)
    for first, last in arrow_text.slices(offsets):
        part = data[offsets[first] : offsets[last]]
        for k, found in enumerate(arrow_text.shingles(part, offsets[first : last + 1] - offsets[first], width)):
            distinct = np.unique(found)
            digest = hashlib.blake2b(distinct.tobytes(), digest_size=8).digest()
            yield first + k, distinct, int.from_bytes(digest, "little", signed=True)


def shingle_classes(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, ref): set size and the hash that names the document's class."""

    def run(batches):
        for batch in batches:
            sizes, refs = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for row, distinct, ref in shingle_sets(batch.column(1), width):
                sizes[row], refs[row] = len(distinct), ref
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(refs)], ["doc_id", "n_shingles", "ref"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, ref long")


def _short(counts: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Run lengths as 16-bit numbers; a longer run is listed as several, with its entries in ``columns`` repeated."""
    parts = (counts + 0xFFFE) // 0xFFFF
    whole = np.repeat(np.full(len(counts), 0xFFFF), parts)
    ends = np.cumsum(parts) - 1
    whole[ends] = counts - 0xFFFF * (parts - 1)
    return [whole.astype("<u2"), *(np.repeat(c, parts) for c in columns)]


def _planes(values: np.ndarray) -> bytes:
    """Numbers by the place of their bytes, all first bytes first: places where most of them agree weigh little when shuffled."""
    return values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()


def _from_planes(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """The numbers of all rows of a column that ``_planes`` has packed."""
    packed, width = column.to_pylist(), np.dtype(kind).itemsize
    out = np.empty((sum(map(len, packed)) // width, width), np.uint8)
    at = 0
    for x in packed:
        many = len(x) // width
        out[at : at + many] = np.frombuffer(x, np.uint8).reshape(width, many).T
        at += many
    return out.reshape(-1).view(kind)


def _dealt(docs: DataFrame, width: int, blocks: int) -> DataFrame:
    """Shingles by block of the hash range, packed: a row for each batch and block."""
    names = ["block", "refs", "sizes", "counts", "high", "low"]

    def dealt(sets):
        # In the order of their names, whose first bytes then repeat.
        refs, parts = (list(x) for x in zip(*sorted(sets.items(), key=lambda x: x[0])))
        sizes = np.array([len(x) for x in parts])
        every = np.concatenate(parts)
        block = ((every & _LOW) % np.uint64(blocks)).astype(np.uint32)
        order = np.argsort(block, kind="stable")
        block, token = block[order], every[order] >> np.uint64(24)
        owner = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)[order]
        high, low = (token >> np.uint64(8)).astype("<u4"), token.astype(np.uint8)
        cuts = np.flatnonzero(np.diff(block, prepend=block[0] ^ 1))
        refs, rows = np.array(refs, "<i8"), []
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(block)]):
            here, runs = np.unique(owner[a:b], return_counts=True)
            runs, here = _short(runs, here)
            owners = (refs[here], sizes[here].astype("<u4"), runs)
            rows.append((int(block[a]), *map(_planes, owners), high[a:b].tobytes(), low[a:b].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names)

    def run(batches):
        for batch in batches:
            column = batch.column(0)
            for first, last in arrow_text.slices(arrow_text.utf8(column)[1], DEALT_BYTES):
                sets = {ref: found for _, found, ref in shingle_sets(column.slice(first, last - first), width) if len(found)}
                if sets:
                    yield dealt(sets)

    schema = "block long, refs binary, sizes binary, counts binary, high binary, low binary"
    return docs.select("text").mapInArrow(run, schema)


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _distinct(token: np.ndarray, owner: np.ndarray, classes: int, packed: int = 1 << 24) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of a 40-bit token and a class number, in order; packed into 64 bits where the numbers fit."""
    if classes <= packed:
        pairs = token << np.uint64(24)
        pairs |= owner.astype(np.uint64)
        pairs.sort()
        new = np.ones(len(pairs), bool)
        new[1:] = pairs[1:] != pairs[:-1]
        pairs = pairs[new]
        return pairs >> np.uint64(24), (pairs & _LOW).astype(np.int64)
    order = np.lexsort((owner, token))
    token, owner = token[order], owner[order].astype(np.int64)
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    return token[new], owner[new]


def _shared(homes: int):
    """Of one block, the shingles of two or more classes, with class counts, packed by the home of their class."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        refs, first, back = np.unique(_from_planes(table["refs"], "<i8"), return_index=True, return_inverse=True)
        sizes = _from_planes(table["sizes"], "<u4")[first]
        owners = np.repeat(back.astype(np.uint32), _from_planes(table["counts"], "<u2"))
        high, low = _joined(table["high"], "<u4"), _joined(table["low"], np.uint8)
        parts, found = min(255, max(1, -(-len(low) // PART_SHINGLES))), []
        for part in range(parts):
            here = np.flatnonzero(low % np.uint8(parts) == part) if parts > 1 else slice(None)
            token = high[here].astype(np.uint64)
            token <<= np.uint64(8)
            token |= low[here]
            token, owner = _distinct(token, owners[here], len(refs))
            runs = np.flatnonzero(np.diff(token, prepend=~token[:1]))
            many = np.diff(runs, append=len(token)).astype(np.uint32)
            count = np.repeat(many, many)
            keep = count > 1
            found.append((token[keep] | np.uint64(key[0].as_py() << 40), owner[keep], count[keep]))
        token, owner, count = (np.concatenate(x) for x in zip(*found))
        home = arrow_text.mix(refs.view(np.uint64)) % np.uint64(homes)
        order = np.lexsort((owner, home[owner]))
        token, owner, count = token[order], owner[order], count[order]
        at = home[owner]
        cuts = np.flatnonzero(np.diff(at, prepend=~at[:1]))
        rows = []
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)]):
            here, lengths = np.unique(owner[a:b], return_counts=True)
            lengths, here = _short(lengths, here)
            packed = (refs[here], sizes[here].astype("<u4"), lengths, token[a:b].astype("<u8"), count[a:b].astype("<u4"))
            rows.append((int(at[a]), *map(_planes, packed)))
        columns = list(zip(*rows)) or [()] * 6
        kinds = [pa.int64()] + [pa.binary()] * 5
        names = ["home", "refs", "sizes", "runs", "tokens", "counts"]
        return pa.table({c: pa.array(list(v), k) for c, v, k in zip(names, columns, kinds)})

    return run


def _profiled(percent: int):
    """Of the classes of one home, those that can have a partner: shingles in global order, prefix, name of the group."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        runs = _from_planes(table["runs"], "<u2")
        refs, first, owner = np.unique(_from_planes(table["refs"], "<i8"), return_index=True, return_inverse=True)
        sizes = _from_planes(table["sizes"], "<u4")[first].astype(np.int64)
        owner = np.repeat(owner, runs)
        shared = np.bincount(owner, minlength=len(refs))
        able = 100 * shared >= percent * sizes
        keep = able[owner]
        owner = owner[keep]
        token, count = _from_planes(table["tokens"], "<u8")[keep], _from_planes(table["counts"], "<u4")[keep]
        order = np.lexsort((token, count, owner))
        token = token[order]
        ends = np.cumsum(np.where(able, shared, 0))
        rows = []
        for k in np.flatnonzero(able).tolist():
            own, n = token[ends[k] - shared[k] : ends[k]], int(sizes[k])
            # Shingles of this class alone come first in the order and take their share of the prefix.
            prefix = own[: len(own) - _needed(n, percent) + 1]
            group = hashlib.blake2b(n.to_bytes(8, "little") + prefix.tobytes(), digest_size=8).digest()
            name = int.from_bytes(group, "little", signed=True)
            rows.append((int(refs[k]), n, own.astype("<u8").tobytes(), prefix.view("<i8"), name))
        columns = list(zip(*rows)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64()]
        names = ["ref", "n", "tokens", "prefix", "gid"]
        return pa.table({c: pa.array(list(v), k) for c, v, k in zip(names, columns, kinds)})

    return run


def _needed(n: int, percent: int) -> int:
    """The least overlap that any partner must have with a set of n."""
    return -(-percent * n // 100)


def _products(left: list[np.ndarray], right: list[np.ndarray], step: int = 8192) -> np.ndarray:
    """Intersection sizes of all sets on the left with all on the right."""
    a, b = np.concatenate(left), np.concatenate(right)
    rows_a = np.repeat(np.arange(len(left)), [len(x) for x in left])
    rows_b = np.repeat(np.arange(len(right)), [len(x) for x in right])
    common = np.intersect1d(a, b)
    at_a, at_b = np.searchsorted(common, a), np.searchsorted(common, b)
    in_a = (at_a < len(common)) & (common[np.minimum(at_a, len(common) - 1)] == a) if len(common) else np.zeros(len(a), bool)
    in_b = (at_b < len(common)) & (common[np.minimum(at_b, len(common) - 1)] == b) if len(common) else np.zeros(len(b), bool)
    at_a, rows_a, at_b, rows_b = at_a[in_a], rows_a[in_a], at_b[in_b], rows_b[in_b]
    order_a, order_b = np.argsort(at_a, kind="stable"), np.argsort(at_b, kind="stable")
    at_a, rows_a, at_b, rows_b = at_a[order_a], rows_a[order_a], at_b[order_b], rows_b[order_b]
    total = np.zeros((len(left), len(right)), np.int64)
    for low in range(0, len(common), step):
        high = min(low + step, len(common))
        sides = []
        for at, rows, size in ((at_a, rows_a, len(left)), (at_b, rows_b, len(right))):
            x, y = np.searchsorted(at, [low, high])
            present = np.zeros((size, high - low), np.float32)
            present[rows[x:y], at[x:y] - low] = 1
            sides.append(present)
        total += (sides[0] @ sides[1].T).astype(np.int64)
    return total


def _spanning(link: np.ndarray) -> list[tuple[int, int]]:
    """A tree of links over each linked part of a symmetric matrix."""
    todo, edges = set(range(len(link))), []
    while todo:
        front = [todo.pop()]
        while front:
            at = front.pop()
            near = [x for x in np.flatnonzero(link[at]).tolist() if x in todo]
            todo.difference_update(near)
            edges += [(at, x) for x in near]
            front += near
    return edges


def _verified(percent: int):
    """Links of one block: spanning pairs (a, b), and per class the documents that it links with (a, weight)."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        refs, n, copies = (table[c].to_numpy() for c in ("ref", "n", "copies"))
        sets = [np.frombuffer(x, "<u8") for x in table["tokens"].to_pylist()]
        side = table["side"].to_numpy()
        left = np.flatnonzero(side == 0)
        right = left if key[1].as_py() == key[2].as_py() else np.flatnonzero(side == 1)
        out: list[tuple] = []
        if len(left) and len(right):
            shared = _products([sets[k] for k in left], [sets[k] for k in right])
            close = 100 * shared >= percent * (n[left][:, None] + n[right][None, :] - shared)
            if right is left:
                np.fill_diagonal(close, False)
                full = close
            else:
                full = np.zeros((len(sets), len(sets)), bool)
                full[np.ix_(left, right)] = close
                full[np.ix_(right, left)] = close.T
            order = left if right is left else np.arange(len(sets))
            names = refs[order]
            out += [(int(names[x]), int(names[y]), None) for x, y in _spanning(full)]
            weight = full @ copies[order]
            out += [(int(names[k]), None, int(weight[k])) for k in np.flatnonzero(weight)]
        columns = list(zip(*out)) or [(), (), ()]
        return pa.table({c: pa.array(list(v), pa.int64()) for c, v in zip(("a", "b", "weight"), columns)})

    return run


def _profiles(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    # One total decides how many blocks there are, so that a block is bounded at any size.
    chars = docs.select(F.sum(F.length("text"))).first()[0] or 0
    blocks, homes = (max(spark.sparkContext.defaultParallelism, -(-chars // x)) for x in (BLOCK_CHARS, HOME_CHARS))
    packed = "refs binary, sizes binary, runs binary, tokens binary, counts binary"
    profiled = (
        _dealt(docs, width, blocks)
        .groupBy("block")
        .applyInArrow(_shared(homes), f"home long, {packed}")
        .groupBy("home")
        .applyInArrow(_profiled(percent), "ref long, n long, tokens binary, prefix array<long>, gid long")
    )
    # Stored by itself: Spark sees its size before it joins.
    several = materialize(classes.where("copies > 1").select("ref", "copies"), "several")
    counted = profiled.join(several, "ref", "left").withColumn("copies", F.coalesce("copies", F.lit(1)).cast("long"))
    return materialize(counted, "profiles")


def _candidate_groups(profiles: DataFrame, percent: int) -> DataFrame:
    """(node, component) of groups that hang together by prefixes and sizes."""
    # Sizes within the likeness of each other lie in one class of this width or in two that follow each other.
    level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9)
    entries = (
        profiles.dropDuplicates(["gid"])
        .select("gid", level.alias("level"), F.explode("prefix").alias("token"))
    )
    shared = entries.groupBy("token").agg(
        F.min("gid").alias("rep"), F.count("*").alias("here"), (F.max("level") - F.min("level")).alias("span")
    ).where("here > 1")
    met = materialize(entries.join(shared.drop("here"), "token"), "meetings")
    # Where all sizes lie that close, one representative serves the shingle; else each size class has its own.
    near = met.where("span <= 1").select("gid", "rep")
    wide = met.where("span > 1").select("token", "level", "gid")
    first = wide.groupBy("token", "level").agg(F.min("gid").alias("rep"))
    above = first.select("token", (F.col("level") - 1).alias("level"), F.col("rep").alias("next"))
    inside = wide.join(first, ["token", "level"]).select("gid", "rep")
    across = first.join(above, ["token", "level"]).select(F.col("rep").alias("gid"), F.col("next").alias("rep"))
    edges = near.unionByName(inside).unionByName(across).where("gid <> rep").distinct()
    return components(materialize(edges, "candidates"), "gid", "rep")


def members(docs: DataFrame, width: int = 5) -> DataFrame:
    """``docs`` without ``text``, with its distinct shingles packed in ``tokens``."""
    rest = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(rest).schema)

    def run(batches):
        for batch in batches:
            packed = [b""] * batch.num_rows
            for row, distinct, _ in shingle_sets(batch.column(len(rest)), width):
                packed[row] = distinct.astype("<u8").tobytes()
            arrays = [batch.column(k) for k in range(len(rest))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(packed, pa.binary())], [*rest, "tokens"])

    return docs.select(*rest, "text").mapInArrow(run, f"{schema}, tokens binary")


def verified_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among ``members`` (cluster, ref, n, copies), all against all within a cluster.

    ``sets`` has (ref, tokens); the sets move only once it is known where to. Rows (a, b, null) span each linked part;
    rows (a, null, weight) count the documents that ``a`` links with.
    """
    sizes = (
        members.groupBy("cluster")
        .agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
        .where("sets > 1")
        .select(
            "cluster",
            F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).alias("chunks"),
        )
    )
    chunked = members.join(sizes, "cluster").withColumn("chunk", F.pmod(F.xxhash64("ref"), F.col("chunks")))
    # Chunk c meets every chunk of its cluster once: as the left side of (c, j) and the right side of (i, c).
    met = chunked.select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other")
    ).select(
        "cluster",
        F.least("chunk", "other").alias("i"),
        F.greatest("chunk", "other").alias("j"),
        F.when(F.col("chunk") <= F.col("other"), 0).otherwise(1).alias("side"),
        "ref", "n", "copies",
    )
    blocks = met.join(sets.select("ref", "tokens"), "ref").groupBy("cluster", "i", "j")
    return blocks.applyInArrow(_verified(percent), "a long, b long, weight long")


def labelled(listed: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """``listed`` (doc_id, n_shingles, ref) with component_id and n_links; ``classes`` has (ref, copies, lowest).

    Only classes with copies or links need a lookup; all other documents stand alone.
    """
    joined = components(links.where("b IS NOT NULL").select("a", "b"))
    degrees = links.where("weight IS NOT NULL").groupBy("a").agg(F.sum("weight").alias("others"))
    known = (
        classes.join(joined.withColumnRenamed("node", "ref"), "ref", "left")
        .join(degrees.withColumnRenamed("a", "ref"), "ref", "left")
        .where("copies > 1 OR component IS NOT NULL")
        .select(
            "ref",
            F.coalesce("component", "ref").alias("root"),
            "lowest",
            (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        )
    )
    known = materialize(known, "linked")
    lowest = known.groupBy("root").agg(F.min("lowest").alias("component_id"))
    facts = known.join(lowest, "root").select("ref", "component_id", "n_links", F.lit(True).alias("known"))
    linked = F.col("known") & (F.col("n_shingles") > 0)
    return listed.join(facts, "ref", "left").select(
        *(c for c in listed.columns if c != "ref"),
        F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(linked, F.col("n_links")).otherwise(F.lit(0)).alias("n_links"),
    )


def jaccard_join(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row of ``docs`` (doc_id, text).

    Documents link when 100 * shared >= percent * union of their shingle sets. ``n_links`` counts the other rows
    that a row links with, copies included; ``component_id`` is the smallest doc_id that links reach.
    """
    listed = materialize(shingle_classes(docs, width), "classes")
    classes = (
        listed.where("n_shingles > 0")
        .groupBy("ref")
        .agg(
            F.first("n_shingles").alias("n"), F.count("*").alias("copies"), F.min("doc_id").alias("lowest")
        )
    )
    profiles = _profiles(docs, classes.select("ref", "n", "copies"), width, percent)
    groups = _candidate_groups(profiles, percent)
    clustered = profiles.select("ref", "n", "copies", "gid").join(groups, F.col("gid") == F.col("node"), "left")
    clustered = clustered.select(F.coalesce("component", "gid").alias("cluster"), "ref", "n", "copies")
    links = materialize(verified_links(clustered, profiles, percent), "links")
    return labelled(listed, classes.drop("n"), links).select("doc_id", "n_shingles", "component_id", "n_links")
