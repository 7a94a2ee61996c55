"""MinHash fingerprints of documents, and near duplicates by signature bands.

A text's shingles (five words, as in the n-gram join) go through ``PERMUTATIONS`` universal hash permutations of 32-bit
values, x -> a x + b with odd a, as numpy blocks; the low 16 bits of each minimum make the signature. The likeness of
two fingerprints is the share of equal entries, an estimate of the Jaccard likeness of the shingle sets with a standard
error of at most 0.045.

``fingerprinted`` follows every document by the next in the order of ids. Documents are dealt out by ranges of ids, texts
compressed, each range with a copy of the first document of the range after it, so that a text moves once.

``near_duplicates`` joins documents that share a band of four entries, ties each band to one representative instead of
listing its pairs, and verifies what hangs together by the Jaccard likeness of the full shingle sets. At 0.75 a pair
shares none of the 32 bands with probability 5e-6.

Defined results: null or wordless text has no shingles, a fingerprint of ffff and likeness 1 to the like, 0 to all others;
rows with equal or null ids follow each other in the order of their compressed bytes, null ids first; the document after the
last is the first, so a single one follows itself; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelkin.llm import arrow_text, ngram_join
from pixelkin.operators.components import components
from pixelkin.session import materialize

PERMUTATIONS, BAND = 128, 4
_rng = np.random.default_rng(19970611)
_FACTORS = (_rng.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * 2 + 1)[:, None]
_TERMS = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)[:, None]
_BLOCK = 1024
_LEAST = -(1 << 63)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Low 16 bits of the least value of every permutation; all ones without shingles."""
    least = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), _BLOCK):
        values = _FACTORS * high[None, at : at + _BLOCK]
        values += _TERMS
        np.minimum(least, values.min(axis=1), out=least)
    return least.astype(np.uint16)


def signatures(texts: pa.Array) -> list[np.ndarray]:
    data, offsets = arrow_text.utf8(texts)
    out = []
    for first, last in arrow_text.slices(offsets):
        part = data[offsets[first] : offsets[last]]
        out += map(signature, arrow_text.shingles(part, offsets[first : last + 1] - offsets[first]))
    return out


def _printed(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def _likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def _dealt(docs: DataFrame, cuts: list[int], firsts: dict[int, int], ring: dict[int, int]) -> DataFrame:
    """(bucket, peek, at, doc_id, packed): compressed texts by range, and each range's first row for the one before."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["bucket", "peek", "at", "doc_id", "packed"]

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        edges = np.array(cuts, np.int64)
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False)
            packed = [pack((t.as_py() or "").encode()) for t in batch.column(2)]
            bucket = np.searchsorted(edges, at, "right")
            again = [k for k, (b, x) in enumerate(zip(bucket.tolist(), at.tolist())) if firsts[b] == x]
            rows = pa.array([*range(len(at)), *again], pa.int64())
            home = [*bucket.tolist(), *(ring[int(bucket[k])] for k in again)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(home, pa.int32()),
                    pa.array([False] * len(at) + [True] * len(again)),
                    batch.column(0).take(rows),
                    batch.column(1).take(rows),
                    pa.array(packed, pa.binary()).take(rows),
                ],
                names,
            )

    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("at"), "doc_id", "text")
    return keyed.mapInArrow(run, f"bucket int, peek boolean, at long, doc_id {kind}, packed binary")


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _followed(kind: str):
    """Fingerprints of sorted ranges: each row with the row after it."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        last = None  # (bucket, id, text, signature) that waits for the row after it
        for batch in batches:
            texts = [unpack(p.as_py()).decode() for p in batch.column(4)]
            signed = signatures(pa.array(texts, pa.large_string()))
            pairs = []
            for bucket, peek, number, text, sig in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), texts, signed
            ):
                if last is not None and last[0] == bucket:
                    pairs.append((last, text, sig))
                    last = None
                if not peek:
                    last = (bucket, number, text, sig)
            edited = [_edited(own[2], text) for own, text, _ in pairs]
            rows = []
            for (own, _, following), text, sig in zip(pairs, edited, signatures(pa.array(edited, pa.large_string()))):
                rows.append(
                    (
                        own[1], len(own[2]), hashlib.sha256(text.encode()).hexdigest(),
                        _printed(own[3]), _printed(sig), _likeness(own[3], sig), _likeness(own[3], following),
                    )
                )
            columns = list(zip(*rows)) or [()] * len(names)
            of_id = batch.column(3).type
            yield pa.RecordBatch.from_arrays([pa.array(c, k or of_id) for c, k in zip(columns, kinds)], names)

    return run


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id, text), of its edited text and their likeness.

    The edited text has the last half of the letters replaced by the first ones of the next document.
    """
    spark = docs.sparkSession
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST))
    marks = [k / ranges for k in range(1, ranges)]
    # As many ids as there are ranges.
    cuts = docs.select(F.percentile_approx(at, marks, 20 * ranges)).first()[0]
    if cuts is None:
        cuts = []
    cuts = sorted(set(cuts))
    edges = F.lit(cuts) if cuts else F.array().cast("array<long>")
    bucket = F.size(F.filter(edges, lambda c: c <= at))
    firsts = {r["b"]: r["first"] for r in docs.groupBy(bucket.alias("b")).agg(F.min(at).alias("first")).collect()}
    order = sorted(firsts)
    ring = {b: order[k - 1] for k, b in enumerate(order)}
    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = _dealt(docs, cuts, firsts, ring).repartition(ranges, "bucket")
    return dealt.sortWithinPartitions("bucket", "peek", "at", "packed").mapInArrow(
        _followed(kind),
        f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


def _sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, key, ref, n, bands): hash of the text, name and size of its shingle set, a hash for every band of the signature."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            refs, sizes, bands = [0] * batch.num_rows, [0] * batch.num_rows, [[] for _ in range(batch.num_rows)]
            for row, distinct, ref in ngram_join.shingle_sets(batch.column(1), 5):
                refs[row], sizes[row] = ref, len(distinct)
                if len(distinct):
                    rows = np.ascontiguousarray(signature(distinct).reshape(-1, BAND)).view(np.uint64)[:, 0]
                    bands[row] = (rows ^ arrow_text.mix(np.arange(len(rows), dtype=np.uint64) + np.uint64(1))).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(refs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "key", "ref", "n", "bands"],
            )

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    return keyed.mapInArrow(run, f"doc_id {kind}, key long, ref long, n long, bands array<long>")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, class_id, n_links) of every row: smallest id that verified links reach, and how many rows it links with."""
    sketched = materialize(_sketched(docs), "sketched")
    sets = materialize(
        sketched.where("n > 0").groupBy("ref").agg(
            F.first("n").alias("n"), F.count("*").alias("copies"), F.min("doc_id").alias("lowest"), F.first("bands").alias("bands")
        ),
        "sets",
    )
    # Entries with their band's number and value; a band ties its sets to the smallest.
    entries = sets.select("ref", F.posexplode("bands").alias("band", "value"))
    tied = entries.groupBy("band", "value").agg(F.min("ref").alias("rep"), F.count("*").alias("here")).where("here > 1")
    edges = entries.join(tied, ["band", "value"]).where("ref <> rep").select("ref", "rep").distinct()
    clusters = components(materialize(edges, "bands"), "ref", "rep").toDF("ref", "cluster")
    # One text of each set, found again by its hash: an id may be missing or have several texts.
    wanted = sketched.select("key", "ref").join(clusters, "ref").groupBy("ref", "cluster").agg(F.min("key").alias("key"))
    texts = docs.select(F.xxhash64("text").alias("key"), "text").join(wanted, "key").drop("key")
    members = materialize(ngram_join.members(texts.dropDuplicates(["ref"])), "members")
    counted = members.select("cluster", "ref").join(sets.select("ref", "n", "copies"), "ref")
    links = materialize(ngram_join.verified_links(counted, members, percent), "links")
    return ngram_join.labelled(
        sketched.drop("key").withColumnRenamed("n", "n_shingles"), sets.select("ref", "copies", "lowest"), links
    ).select("doc_id", F.col("component_id").alias("class_id"), "n_links")
