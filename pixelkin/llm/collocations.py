"""Phrase collocations by relational mining of sorted occurrence relations (SETM).

The relation of length k has a row for every occurrence of a frequent k-word phrase: place and phrase. It is stored in
blocks of whole pieces, sorted by place; places count words and skip a number between pieces, so two occurrences
follow each other in one piece exactly if their places do. One length leads to the next by three steps:

* merge-join: an occurrence meets the one at the next place; both are frequent, the overlap is a candidate of k + 1 words;
* group and count: a block counts its candidates once, packed and dealt out by hash, and the sums over all blocks decide;
* semi-join: every block gets those of its own candidates that are frequent, with their numbers, and keeps their
  occurrences.

A phrase that occurs everywhere is one entry of each block. Frequent phrases are numbered; a longer one is known by the
numbers of its two overlapping parts, so hashes (64 bits) tell only words from each other and deal out the rest. What
follows (texts, cuts, containment, ranks) are DataFrame joins of frequent phrases.

Defined results: null or empty text has no words; a null ``lang`` is "und"; repeated rows count each time; an empty
table gives no phrase; other columns are ignored. Texts are cut into blocks at the borders of pieces, so a block is
bounded unless a single piece is longer. Scores and limits are decimals of 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelkin.llm import arrow_text
from pixelkin.session import materialize

#: Bytes of text in one block, bytes that a task holds for all languages, and words whose groups meet in one task.
BLOCK_BYTES = 10 << 20
HELD_BYTES = 40 << 20
PART_WORDS = 4_000_000
#: Ranks are found within this many parts of a language first.
RANK_PARTS = 64

_PIECE_END, _SPACE = 2, 1
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b" \t")] = _SPACE
_CLASS[list(b".,;:!?\n\x0b\x0c\r")] = _PIECE_END
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _packed(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.flatnonzero(new)


def _occurrences(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first byte, last byte) of every word of a text."""
    data = np.frombuffer(text, np.uint8)
    kind = _CLASS[data]
    inside = kind == 0
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    if not len(first):
        return (np.zeros(0, np.int64),) * 4
    ends = np.searchsorted(np.flatnonzero(kind == _PIECE_END), first)
    place = np.arange(len(first)) + np.cumsum(np.diff(ends, prepend=ends[0]) > 0)
    hashes = []
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(last, first[at] + arrow_text.SLICE_BYTES, "right")))
        base = first[at]
        hashes.append(arrow_text.run_hashes(data[base : last[to - 1]], first[at:to] - base, last[at:to] - base))
        at = to
    return place, np.concatenate(hashes), first, last


def _cut(text: bytes) -> Iterator[bytes]:
    """``text`` in blocks that end with a piece, then what is left of it."""
    at, data = 0, np.frombuffer(text, np.uint8)
    while len(text) - at > BLOCK_BYTES:
        window = at + BLOCK_BYTES
        back = np.flatnonzero(_CLASS[data[at:window]] == _PIECE_END)
        if len(back):
            to = at + int(back[-1]) + 1
        else:
            while window < len(text) and not (_CLASS[data[window : window + 65536]] == _PIECE_END).any():
                window += 65536
            here = np.flatnonzero(_CLASS[data[window : window + 65536]] == _PIECE_END)
            to = window + int(here[0]) + 1 if len(here) else len(text)
        yield text[at:to]
        at = to
    yield text[at:]


_RELATION = "lang string, block long, words long, places binary, ids binary, keys binary, names binary"
_RELATION_NAMES = ["lang", "block", "words", "places", "ids", "keys", "names"]


def _relation_row(lang: str, block: int, place: np.ndarray, key: np.ndarray, names=lambda first: []) -> tuple:
    keys, first, ids, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    # Frequent ones get small numbers, which pack best.
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(keys), np.uint32)
    rank[order] = np.arange(len(keys), dtype=np.uint32)
    steps = _packed(np.diff(place, prepend=0).astype("<u4"))
    named = zstandard.ZstdCompressor(level=1).compress(b"\n".join(names(first[order])))
    return lang, block, len(place), steps, _packed(rank[ids]), _packed(keys[order].astype("<u8")), named


def _places(row: dict) -> np.ndarray:
    return np.cumsum(_unpacked(row["places"], "<u4"), dtype=np.int64)


def occurrence_relation(docs: DataFrame) -> DataFrame:
    """The relation of single words, in blocks; must be stored before its block numbers are used."""

    def run(batches):
        task, serial = TaskContext.get().partitionId(), 0
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def blocks(lang: str, final: bool):
            nonlocal serial
            rows = []
            *whole, rest = _cut(b"\n".join(held.pop(lang)))
            sizes.pop(lang)
            if final:
                whole.append(rest)
            elif rest:
                held[lang], sizes[lang] = [rest], len(rest)
            for text in whole:
                place, key, first, last = _occurrences(text)
                if len(place):
                    def names(at):
                        return [text[a:b].lower() for a, b in zip(first[at].tolist(), last[at].tolist())]

                    rows.append(_relation_row(lang, (task << 32) | serial, place, key, names))
                    serial += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], _RELATION_NAMES)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                text = text.as_py() or b""
                lang = "und" if lang is None else lang
                held.setdefault(lang, []).append(text)
                # Every text counts its own end, so that many empty ones are not held for ever.
                sizes[lang] = sizes.get(lang, 0) + len(text) + 1
                if sizes[lang] > BLOCK_BYTES:
                    yield from blocks(lang, False)
            while sum(sizes.values()) > HELD_BYTES:
                yield from blocks(max(sizes, key=sizes.get), True)
        for lang in list(held):
            yield from blocks(lang, True)

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(lang.alias("lang"), "text").mapInArrow(run, _RELATION)


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return arrow_text.mix(left * _BASE + right)


@dataclass
class _Grouped:
    """A block's candidates in the order in which they are dealt out: by part, then by their parts' numbers."""

    place: np.ndarray
    group: np.ndarray
    left: np.ndarray
    right: np.ndarray
    counts: np.ndarray
    part: np.ndarray

    def parts(self) -> Iterator[tuple[int, int, int]]:
        cuts = _runs(self.part)
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(self.part)]):
            if b > a:
                yield int(self.part[a]), a, b


def _candidates(row: dict, length: int, parts: int) -> _Grouped:
    """Groups of the occurrences of ``length`` words that a row of the relation before leads to."""
    place, key = _places(row), _unpacked(row["keys"], "<u8")[_unpacked(row["ids"], "<u4")]
    if length == 1:
        left, right, name = key, np.zeros(len(key), np.uint64), key
    else:
        at = np.flatnonzero(place[1:] == place[:-1] + 1)
        place, left, right = place[at], key[at], key[at + 1]
        name = _joined(left, right)
    name, first, group, counts = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
    left, right = left[first], right[first]
    part = (arrow_text.mix(name) >> np.uint64(20)) % np.uint64(parts)
    order = np.lexsort((right, left, part))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return _Grouped(place, rank[group], left[order], right[order], counts[order], part[order])


def _groups(relation: DataFrame, length: int, parts: int) -> DataFrame:
    """Every block's candidates with their counts, a row for each block and part of the hash range."""
    columns = ["lang", "part", "block", "left", "right", "counts", "names"]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                found = _candidates(row, length, parts)
                out = []
                named = None
                if length == 1 and len(found.left):
                    texts = zstandard.ZstdDecompressor().decompress(row["names"]).split(b"\n")
                    named = dict(zip(_unpacked(row["keys"], "<u8").tolist(), texts))
                for part, a, b in found.parts():
                    texts = b"\n".join([named[k] for k in found.left[a:b].tolist()]) if named else b""
                    packed = (_packed(found.left[a:b]), _packed(found.right[a:b]), _packed(found.counts[a:b].astype("<u4")))
                    out.append((row["lang"], part, row["block"], *packed, texts))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], columns)

    schema = "lang string, part long, block long, left binary, right binary, counts binary, names binary"
    names = "names" if length == 1 else "NULL AS names"
    return relation.selectExpr("lang", "block", "places", "ids", "keys", names).mapInArrow(run, schema)


_FOUND = "lang string, part long, block long, left binary, right binary, counts binary, ids binary, names binary"
_PART_GROUPS = 1 << 24


def _frequent(length: int, at_least: int):
    """Of one part of the hash range: a row of all frequent groups, numbered, and for each block the places of its own."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lang, part = key[0].as_py(), key[1].as_py()
        blocks = table["block"].to_numpy()
        left = [_unpacked(x, "<u8") for x in table["left"].to_pylist()]
        sizes = np.array([len(x) for x in left])
        left = np.concatenate(left)
        right = np.concatenate([_unpacked(x, "<u8") for x in table["right"].to_pylist()])
        counts = np.concatenate([_unpacked(x, "<u4") for x in table["counts"].to_pylist()])
        name = _joined(left, right) if length > 1 else left
        order = np.argsort(name, kind="stable")
        first = _runs(name[order])
        total = np.add.reduceat(counts[order].astype(np.int64), first)
        often = total >= at_least
        rows: list[tuple] = []
        if often.any():
            at = order[first[often]]
            if len(at) >= _PART_GROUPS:
                raise ValueError("a part has too many frequent groups")
            texts = b""
            if length == 1:
                named = [x for own in table["names"].to_pylist() for x in own.split(b"\n")]
                texts = b"\n".join([named[k] for k in at.tolist()])
            ids = np.arange(len(at), dtype="<u8") + np.uint64(part * _PART_GROUPS)
            rows.append((lang, part, None, _packed(left[at]), _packed(right[at]), _packed(total[often].astype("<i8")), _packed(ids), texts))
            number = np.full(len(name), -1, np.int64)
            kept = np.repeat(often, np.diff(first, append=len(order)))
            number[order[kept]] = (np.cumsum(often) - 1).repeat(np.diff(first, append=len(order)))[kept]
            ends = np.cumsum(sizes)
            for k in range(len(blocks)):
                own = number[ends[k] - sizes[k] : ends[k]]
                places = np.flatnonzero(own >= 0)
                if len(places):
                    steps = _packed(np.diff(places, prepend=0).astype("<u4"))
                    rows.append((lang, part, int(blocks[k]), steps, None, None, _packed(ids[own[places]]), None))
        columns = list(zip(*rows)) or [()] * 8
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
        names = ["lang", "part", "block", "left", "right", "counts", "ids", "names"]
        return pa.table({c: pa.array(list(v), k) for c, v, k in zip(names, columns, kinds)})

    return run


def _phrase_keys(found: DataFrame, length: int) -> DataFrame:
    """(lang, key, left, right, a, word) of all frequent groups."""
    columns = ["lang", "key", "left", "right", "a", "word"]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                numbers = [_unpacked(row[c], "<i8") for c in ("ids", "left", "right", "counts")]
                words = [x.decode() for x in row["names"].split(b"\n")] if length == 1 else [None] * len(numbers[0])
                lang = pa.array([row["lang"]] * len(words), pa.string())
                yield pa.RecordBatch.from_arrays([lang, *map(pa.array, numbers), pa.array(words, pa.string())], columns)

    schema = "lang string, key long, left long, right long, a long, word string"
    return found.where("block IS NULL").mapInArrow(run, schema)


def _kept(length: int, parts: int):
    """The semi-join: occurrences of the candidates that are frequent, as the relation of the next length."""

    def run(relation: pa.Table, frequent: pa.Table) -> pa.Table:
        rows = []
        lists = frequent.select(["part", "left", "ids"]).to_pylist()
        for row in relation.to_pylist() if lists else []:
            found = _candidates(row, length, parts)
            start = {part: a for part, a, _ in found.parts()}
            number = np.full(len(found.left), -1, np.int64)
            for own in lists:
                places = np.cumsum(_unpacked(own["left"], "<u4"), dtype=np.int64)
                number[start[own["part"]] + places] = _unpacked(own["ids"], "<i8")
            number = number[found.group]
            hit = number >= 0
            rows.append(_relation_row(row["lang"], row["block"], found.place[hit], number[hit].astype(np.uint64)))
        columns = list(zip(*rows)) or [()] * len(_RELATION_NAMES)
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
        return pa.table({c: pa.array(list(v), k) for c, v, k in zip(_RELATION_NAMES, columns, kinds)})

    return run


def frequent_phrases(docs: DataFrame, longest: int, at_least: int) -> tuple[DataFrame, DataFrame]:
    """((lang, length, phrase, a) of all phrases of 1 to ``longest`` words in ``at_least`` places, (lang, n))."""
    relation = materialize(occurrence_relation(docs), "occurrences-1")
    totals = relation.groupBy("lang").agg(F.sum("words").alias("n"))
    words = totals.agg(F.sum("n")).first()[0] or 0
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-words // PART_WORDS))
    phrases, before = [], None
    for length in range(1, longest + 1):
        found = materialize(
            _groups(relation, length, parts).groupBy("lang", "part").applyInArrow(_frequent(length, at_least), _FOUND),
            f"groups-{length}",
        )
        keys = _phrase_keys(found, length)
        if before is None:
            texts = keys.select("lang", "key", "a", F.col("word").alias("phrase"))
        else:
            head = before.select("lang", F.col("key").alias("left"), F.col("phrase").alias("head"))
            tail = before.select("lang", F.col("key").alias("right"), F.substring_index("phrase", " ", -1).alias("tail"))
            texts = keys.join(head, ["lang", "left"]).join(tail, ["lang", "right"]).select(
                "lang", "key", "a", F.concat_ws(" ", "head", "tail").alias("phrase")
            )
        before = materialize(texts, f"phrases-{length}")
        phrases.append(before.select("lang", F.lit(length).alias("length"), "phrase", "a"))
        if length < longest:
            mine = found.where("block IS NOT NULL").select("block", "part", "left", "ids")
            relation = materialize(
                relation.groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(_kept(length, parts), _RELATION),
                f"occurrences-{length + 1}",
            )
    out = phrases[0]
    for more in phrases[1:]:
        out = out.unionByName(more)
    return out, totals


def _part(phrase: str, start: str, size: str) -> F.Column:
    return F.expr(f"array_join(slice(split({phrase}, ' '), {start}, {size}), ' ')")


def _ratio_floor(above: str, below: str) -> F.Column:
    """floor(above / below) of two decimal expressions, exactly."""
    return F.expr(f"({above}) div ({below})")


def collocations(
    docs: DataFrame, longest: int = 4, at_least: int = 30, top: int = 2000, scale: int = 2_000_000, inside_percent: int = 80
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to ``longest`` words of every language.

    A phrase that occurs a times scores floor(scale * a / (l + r)) for a cut into parts with l and r occurrences, and
    its worst cut counts. Phrases inside a longer frequent one that has ``inside_percent`` of their occurrences go.
    """
    phrases, totals = frequent_phrases(docs, longest, at_least)
    wide = "CAST({} AS DECIMAL(19, 0))".format
    candidates = phrases.where("length > 1")
    longer = phrases.where("length > 2").select(
        "lang",
        F.col("a").alias("f"),
        F.explode(
            F.expr(
                "flatten(transform(sequence(2, length - 1), s -> transform(sequence(1, length - s + 1),"
                " p -> array_join(slice(split(phrase, ' '), p, s), ' '))))"
            )
        ).alias("phrase"),
    ).groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").where(
        f"f IS NULL OR 100 * {wide('f')} < {inside_percent} * {wide('a')}"
    )
    cuts = kept.select("lang", "phrase", "a", "length", F.explode(F.expr("sequence(1, length - 1)")).alias("k"))
    cuts = cuts.select("*", _part("phrase", "1", "k").alias("first"), _part("phrase", "k + 1", "length - k").alias("rest"))
    known = phrases.select("lang", "phrase", "a")
    scored = cuts.join(known.toDF("lang", "first", "l"), ["lang", "first"]).join(
        known.toDF("lang", "rest", "r"), ["lang", "rest"]
    )
    score = _ratio_floor(f"{wide('a')} * CAST({scale} AS DECIMAL(19, 0))", f"{wide('l')} + {wide('r')}").cast("long")
    worst = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    rows = worst.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)).alias("part"))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    near = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(f"rank <= {top}")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).where(f"rank <= {top}")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
