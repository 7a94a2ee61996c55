"""Best-fit packing of tokenized documents under several capacities at once.

A piece of a document asks for tokens, one document place and attention cost (the square of its length); a sequence
has so much of each. Pieces are taken longest first. Of the sequences that still have room in every dimension, the
one is chosen that the piece leaves with the smallest weighted norm of its residual capacities (score "norm"), or the
one with the largest weighted dot-product of piece and residual (score "dot"); a new one is opened only when none has room.

What a piece asks for follows from its length, so pieces of one length are interchangeable and so are sequences with
equal residuals. The choice is therefore made for (length, number of pieces) and for runs of equal sequences: the driver
sees one row per possible length, whatever the size of the corpus, and the plan is a few thousand runs. Pieces are
numbered within their length by their task and a sum of task counts, and look up their run. Texts never move.

Defined results: null is the empty text, one piece with the closing id alone; longer documents are cut from the end into
full pieces, so that only the first may be shorter; equal rows, null or equal ids are packed row by row; an empty table
gives no piece; other columns are ignored.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelkin.llm.bpe_automaton import PATTERN
from pixelkin.llm.kept import kept
from pixelkin.session import materialize

#: White space (the property of that name; fixed value) in runs that are cut off before the pattern sees them.
_LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{50000,}")


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds; None does not limit."""

    tokens: int = 1024
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    score: str = "norm"

    def limits(self) -> np.ndarray:
        """Capacities, with the values that tokens imply where nothing else limits them."""
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], np.float64)

    def piece_tokens(self) -> int:
        """The longest piece that an empty sequence takes."""
        return min(self.tokens, math.isqrt(int(self.limits()[2])))


@dataclass
class _Sequences:
    """Runs of sequences with equal residuals: first number, how many, residual capacity, tokens used."""

    first: list[int] = field(default_factory=list)
    count: list[int] = field(default_factory=list)
    residual: list[np.ndarray] = field(default_factory=list)

    def add(self, first: int, count: int, residual: np.ndarray) -> None:
        if count:
            self.first.append(first)
            self.count.append(count)
            self.residual.append(residual)

    def take(self, k: int) -> tuple[int, int, np.ndarray]:
        return self.first.pop(k), self.count.pop(k), self.residual.pop(k)


def plan(lengths: dict[int, int], capacity: Capacity) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, from_piece, to_piece, sequence, per_sequence, offset) for ``lengths`` with their counts.

    Piece i of a length, from_piece <= i < to_piece, goes to sequence + (i - from_piece) div per_sequence, at
    offset + ((i - from_piece) mod per_sequence) * length.
    """
    limits, weights = capacity.limits(), np.array(capacity.weights)
    runs: list[tuple[int, int, int, int, int, int]] = []
    open_, opened = _Sequences(), 0
    for length in sorted(lengths, reverse=True):
        asks = np.array([length, 1, length**2], np.float64)
        if (asks > limits).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        done, total = 0, lengths[length]
        while done < total:
            chosen = _choose(open_, asks, limits, weights, capacity.score)
            if chosen is None:
                each = int((limits // asks).min())
                first, count, residual = opened, -(-(total - done) // each), limits
                opened += count
            else:
                first, count, residual = open_.take(chosen)
                each = int((residual // asks).min())
            placed = min(total - done, each * count)
            offset = int(limits[0] - residual[0])
            runs.append((length, done, done + placed, first, each, offset))
            full, rest = divmod(placed, each)
            open_.add(first, full, residual - each * asks)
            open_.add(first + full, int(rest > 0), residual - rest * asks)
            open_.add(first + full + (rest > 0), count - full - (rest > 0), residual)
            done += placed
    return runs


def _choose(open_: _Sequences, asks: np.ndarray, limits: np.ndarray, weights: np.ndarray, score: str) -> int | None:
    if not open_.residual:
        return None
    residual = np.stack(open_.residual)
    fits = np.flatnonzero((residual >= asks).all(axis=1))
    if not len(fits):
        return None
    if score == "dot":
        value = -((residual[fits] / limits) * (asks / limits) * weights).sum(axis=1)
    else:
        value = ((((residual[fits] - asks) / limits) ** 2) * weights).sum(axis=1)
    return int(fits[np.argmin(value)])


def _vocabulary(file: str, special: tuple[tuple[str, int], ...]) -> tiktoken.Encoding:
    def build() -> tiktoken.Encoding:
        with open(file, "rb") as handle:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, handle)}
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=dict(special))

    return kept(("ranks", file, special), build)


def encoded(encoding: tiktoken.Encoding, text: str) -> list[int]:
    """Ids of a text, added tokens included.

    The library's pattern gives up on very long white space. Before a visible character, all of it but the last is a word
    of its own; at the end of a text all of it is. Such words are taken out here, so the rest is as it would be.
    """
    ids: list[int] = []
    at = 0
    for run in _LONG_SPACE.finditer(text):
        to = run.end() if run.end() == len(text) else run.end() - 1
        ids += encoding.encode(text[at : run.start()], allowed_special="all")
        ids += encoding._encode_single_piece(text[run.start() : to])
        at = to
    return ids + encoding.encode(text[at:], allowed_special="all")


def token_pieces(
    docs: DataFrame,
    ranks_file: str,
    special: dict[str, int],
    end_id: int,
    piece_tokens: int,
    carry: dict[str, tuple[str, Callable[[np.ndarray], object]]],
) -> DataFrame:
    """(doc_id, piece, start, length, part, nth, carried columns): documents as ids, cut into pieces.

    ``carry`` maps a column to (Spark type, function of the piece's ids). ``nth`` numbers the pieces of one length
    within the task ``part``; the result must be stored before its numbers are used.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "part", "nth", *carry]
    schema = f"doc_id {kind}, piece int, start long, length long, part long, nth long" + "".join(
        f", {name} {of}" for name, (of, _) in carry.items()
    )
    arrow = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    specials = tuple(special.items())

    def run(batches):
        encoding = _vocabulary(ranks_file, specials)
        part, used = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            source: list[int] = []
            columns: list[list] = [[] for _ in range(5 + len(carry))]
            for row, text in enumerate(batch.column(1)):
                ids = np.array([*encoded(encoding, text.as_py() or ""), end_id], np.uint32)
                first = len(ids) % piece_tokens or piece_tokens
                for piece, to in enumerate(range(first, len(ids) + 1, piece_tokens)):
                    start = max(0, to - piece_tokens) if piece else 0
                    own = ids[start:to]
                    source.append(row)
                    values = [piece, start, len(own), part, used[len(own)], *(make(own) for _, make in carry.values())]
                    for column, value in zip(columns, values):
                        column.append(value)
                    used[len(own)] += 1
            kinds = [pa.int32(), *[pa.int64()] * 4, *(arrow[of] for of, _ in carry.values())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(source, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names,
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(
    docs: DataFrame,
    ranks_file: str,
    special: dict[str, int],
    end_id: int,
    capacity: Capacity = Capacity(),
    carry: dict[str, tuple[str, Callable[[np.ndarray], object]]] | None = None,
) -> DataFrame:
    """(doc_id, piece, start, length, sequence_id, offset, carried columns), a row per piece.

    Without ``carry`` the pieces come with their ids, as little-endian unsigned 32-bit integers in column ``ids``.
    """
    carry = {"ids": ("binary", lambda ids: ids.astype("<u4").tobytes())} if carry is None else carry
    pieces = materialize(
        token_pieces(docs, ranks_file, special, end_id, capacity.piece_tokens(), carry), "pieces"
    )
    spark = docs.sparkSession
    counts = materialize(pieces.groupBy("length", "part").agg(F.count("*").alias("here")), "lengths")
    # One row per possible length.
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("here").alias("n")).collect()}
    runs = spark.createDataFrame(
        plan(lengths, capacity),
        "length long, from_piece long, to_piece long, sequence long, per_sequence long, at long",
    )
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("here").over(before), F.lit(0))).drop("here")
    numbered = pieces.join(offsets, ["length", "part"]).withColumn("i", F.col("before") + F.col("nth"))
    place = F.col("i") - F.col("from_piece")
    # The runs are bounded by the sequence length, not by the data.
    return (
        numbered.join(F.broadcast(runs), "length")
        .where((F.col("i") >= F.col("from_piece")) & (F.col("i") < F.col("to_piece")))
        .select(
            "doc_id", "piece", "start", "length",
            *carry,
            (F.col("sequence") + F.floor(place / F.col("per_sequence"))).alias("sequence_id"),
            (F.col("at") + place % F.col("per_sequence") * F.col("length")).alias("offset"),
        )
    )
