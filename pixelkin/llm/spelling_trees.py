"""Spelling variants: words at one edit, found with k-d trees over letter-count vectors.

A word is a point: how often it has each letter. One replaced letter moves the point by one up and one down, one
inserted letter by one up, so variants lie in tiny ranges (L1 distance two or one) and equal or neighbouring lengths.

Each length has a k-d tree, grown on the driver from a bounded sample of the vocabulary and split at medians of the widest
dimension. Every word is routed to its leaf; leaves that hold more than a cell may are dealt out to several cells by
hash. The word also visits, as a query, the cells whose boxes its range reaches: those after its own cell in the
tree of its length, all in the tree of the next length. Inside a cell a finer k-d tree with tight boxes is searched
in the same way by all queries at once; points that remain are compared by the parities of their counts, then their counts,
and last by the order of their letters. A pair meets in exactly one cell.

Defined results: null text has no words; a null ``doc_id`` counts as empty text in the hash; repeated rows count each
time; an empty table gives no word; other columns are ignored. The sample decides the shape of trees only, never results.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelkin.session import is_empty, materialize

#: Words that trees are grown from, points wanted in a leaf, points that a cell may hold, leaves of a cell's own tree.
SAMPLE_WORDS = 200_000
LEAF_WORDS = 4_000
CELL_WORDS = 12_000
BUCKET_WORDS = 24
#: Distinct words that a task adds up before it passes them on.
HELD_WORDS = 300_000

#: Latin-1 letters that words consist of, as dimensions: a-z, then U+00C0 to U+00FF.
_DIMENSION = np.full(256, -1, np.int64)
_DIMENSION[ord("a") : ord("z") + 1] = np.arange(26)
_DIMENSION[0xC0:] = 26 + np.arange(64)
DIMENSIONS = 90
_INSERTED, _REPLACED = 1, 2


def vocabulary(docs: DataFrame, least_length: int = 7, least_count: int = 2, every: int = 31) -> DataFrame:
    """(word, n): distinct words with their occurrences, after the letter that a document's hash may take from them."""
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least_length)

    def rows(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"]
        )

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), pc.ascii_lower(batch.column(1))):
                start = zlib.crc32(f"{name}:".encode())
                for word, n in Counter(runs.findall(text.as_py())).items():
                    code = zlib.crc32(word.encode(), start)
                    if code % every == 0:
                        at = code % len(word)
                        word = word[:at] + word[at + 1 :]
                    held[word] += n
                if len(held) > HELD_WORDS:
                    yield rows(held)
                    held = Counter()
        yield rows(held)

    texts = docs.where("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), "text")
    counted = texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where((F.col("n") >= least_count) & (F.length("word") >= least_length))


def _letters(words: list[str], length: int) -> np.ndarray:
    """Words of one length as a matrix of Latin-1 letters."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)


def letter_counts(letters: np.ndarray) -> np.ndarray:
    """Letter-count vectors of a matrix of letters."""
    rows = np.repeat(np.arange(len(letters)), letters.shape[1])
    flat = rows * DIMENSIONS + _DIMENSION[letters].ravel()
    counts = np.bincount(flat, minlength=len(letters) * DIMENSIONS).reshape(len(letters), DIMENSIONS)
    return counts.astype(np.int8 if letters.shape[1] < 128 else np.int32)


def _widest_split(points: np.ndarray) -> tuple[int, int] | None:
    """(dimension, greatest value on the left): the median of the widest dimension; None where all points are equal."""
    low, high = points.min(axis=0), points.max(axis=0)
    spread = high - low
    widest = np.flatnonzero(spread == spread.max())
    if spread[widest[0]] == 0:
        return None
    # Of equally wide dimensions, the one that a median halves best.
    best = None
    for d in widest[:8].tolist():
        values = points[:, d]
        at = int(np.median(values))
        for cut in (at - 1, at):
            if low[d] <= cut < high[d]:
                left = np.count_nonzero(values <= cut)
                if best is None or abs(2 * left - len(points)) < best[0]:
                    best = abs(2 * left - len(points)), d, cut
    return (best[1], best[2]) if best else (int(widest[0]), int(low[widest[0]]))


@dataclass(frozen=True)
class Tree:
    """A k-d tree without points: for node i the split (dimension, cut) and the children; a leaf has its number."""

    dimension: list[int]
    cut: list[int]
    left: list[int]
    right: list[int]
    leaf: list[int]

    @staticmethod
    def grown(points: np.ndarray, leaves: int) -> Tree:
        tree, numbers = Tree([], [], [], [], []), iter(range(1 << 62))
        size = max(1, len(points) // max(1, leaves))

        def grow(own: np.ndarray) -> int:
            node = len(tree.leaf)
            for column in (tree.dimension, tree.cut, tree.left, tree.right, tree.leaf):
                column.append(-1)
            split = _widest_split(own) if len(own) > size else None
            if split is None:
                tree.leaf[node] = next(numbers)
            else:
                inside = own[:, split[0]] <= split[1]
                tree.dimension[node], tree.cut[node] = split
                tree.left[node] = grow(own[inside])
                tree.right[node] = grow(own[~inside])
            return node

        grow(points)
        return tree

    def leaves(self) -> int:
        return 1 + max(self.leaf)

    def home(self, points: np.ndarray) -> np.ndarray:
        """The leaf of every point."""
        out = np.zeros(len(points), np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, own = todo.pop()
            if self.leaf[node] >= 0:
                out[own] = self.leaf[node]
            elif len(own):
                inside = points[own, self.dimension[node]] <= self.cut[node]
                todo += [(self.left[node], own[inside]), (self.right[node], own[~inside])]
        return out

    def reached(self, points: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, points whose range meets the leaf's box): at most ``up`` letters more and ``down`` fewer."""
        wide = 1 << 30
        todo = [(0, np.arange(len(points)), {})]
        while todo:
            node, own, box = todo.pop()
            if not len(own):
                continue
            if self.leaf[node] >= 0:
                yield self.leaf[node], own
                continue
            d, cut = self.dimension[node], self.cut[node]
            low, high = box.get(d, (-wide, wide))
            for child, side in ((self.left[node], (low, min(high, cut))), (self.right[node], (max(low, cut + 1), high))):
                inner = box | {d: side}
                todo.append((child, own[_within(points[own], inner, up, down)], inner))


def _within(points: np.ndarray, box: dict[int, tuple[int, int]], up: int, down: int) -> np.ndarray:
    more = np.zeros(len(points), np.int32)
    fewer = np.zeros(len(points), np.int32)
    for d, (low, high) in box.items():
        values = points[:, d].astype(np.int32)
        more += np.maximum(low - values, 0)
        fewer += np.maximum(values - high, 0)
    return (more <= up) & (fewer <= down)


def _parities(counts: np.ndarray) -> np.ndarray:
    """The parity of every count, as two 64-bit words a point."""
    odd = np.zeros((len(counts), 128), np.uint8)
    odd[:, :DIMENSIONS] = counts & 1
    return np.packbits(odd, axis=1).view(np.uint64)


def close_pairs(queries: np.ndarray, points: np.ndarray, up: int, down: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, point) indexes at L1 distance up + down exactly, by a k-d tree with tight boxes over ``points``."""
    seen_q, seen_p = _parities(queries), _parities(points)
    todo = [(np.arange(len(points)), np.arange(len(queries)))]
    while todo:
        own, active = todo.pop()
        if not len(own) or not len(active):
            continue
        mine = points[own]
        low, high = mine.min(axis=0), mine.max(axis=0)
        asked = queries[active]
        near = (np.maximum(low - asked, 0).sum(axis=1) <= up) & (np.maximum(asked - high, 0).sum(axis=1) <= down)
        active = active[near]
        split = _widest_split(mine) if len(own) > BUCKET_WORDS else None
        if split is not None:
            inside = mine[:, split[0]] <= split[1]
            todo += [(own[inside], active), (own[~inside], active)]
            continue
        for part in range(0, len(own), 4 * BUCKET_WORDS):
            here = own[part : part + 4 * BUCKET_WORDS]
            odd = np.bitwise_count(seen_q[active][:, None, :] ^ seen_p[here][None, :, :]).sum(axis=2, dtype=np.uint8)
            q, p = np.nonzero(odd == up + down)
            q, p = active[q], here[p]
            step = queries[q].astype(np.int32) - points[p]
            exact = (np.maximum(-step, 0).sum(axis=1) == up) & (np.maximum(step, 0).sum(axis=1) == down)
            yield q[exact], p[exact]


def one_edit(shorter: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Whether rows of letters differ by exactly one replaced letter (equal widths) or one inserted into ``shorter``."""
    width = shorter.shape[1]
    if longer.shape[1] == width:
        return (shorter != longer).sum(axis=1) == 1
    head = np.logical_and.accumulate(shorter == longer[:, :-1], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((shorter == longer[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= width


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    lengths = np.array([len(w) for w in words], np.int64)
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order], prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
        if b > a:
            yield int(lengths[order[a]]), order[a:b]


def _trees(words: DataFrame) -> dict[int, Tree]:
    """A tree for every length of the vocabulary."""
    sizes = {r["length"]: r["size"] for r in words.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("size")).collect()}
    total = sum(sizes.values())
    share = -(-total // SAMPLE_WORDS)
    sample = words.where(F.pmod(F.xxhash64("word"), F.lit(share)) == 0).select("word").toArrow()["word"].to_pylist()
    points = {length: letter_counts(_letters([sample[k] for k in at.tolist()], length)) for length, at in _by_length(sample)}
    none = np.zeros((0, DIMENSIONS), np.int8)
    return {n: Tree.grown(points.get(n, none), -(-size // LEAF_WORDS)) for n, size in sizes.items()}


def _routed(words: DataFrame, trees: dict[int, Tree], cells: dict[tuple[int, int], tuple[int, int]]) -> DataFrame:
    """(cell, kind, word, n): every word in its own cell (kind 0) and as a query in the cells that its range reaches.

    ``cells`` has (first cell, number of cells) of every leaf (length, leaf).
    """

    def run(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            crc = np.array([zlib.crc32(w.encode("latin-1")) for w in words], np.int64)
            for length, at in _by_length(words):
                points = letter_counts(_letters([words[k] for k in at.tolist()], length))
                homes = trees[length].home(points)
                spans = np.array([cells[length, leaf] for leaf in range(trees[length].leaves())], np.int64)
                own = spans[homes, 0] + crc[at] % spans[homes, 1]
                out = [(own, np.zeros(len(at), np.int64), at)]
                for kind, tree, up, down in (
                    (_REPLACED, trees[length], 1, 1), (_INSERTED, trees.get(length + 1), 1, 0)
                ):
                    if tree is None:
                        continue
                    for leaf, found in tree.reached(points, up, down):
                        first, many = cells[length + (kind == _INSERTED), leaf]
                        for cell in range(first, first + many):
                            mine = found[own[found] < cell] if kind == _REPLACED else found
                            out.append((np.full(len(mine), cell), np.full(len(mine), kind), at[mine]))
                cell, kind, rows = (np.concatenate(x) for x in zip(*out))
                taken = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell), pa.array(kind), batch.column(0).take(taken), batch.column(1).take(taken)],
                    ["cell", "kind", "word", "n"],
                )

    return words.select("word", "n").mapInArrow(run, "cell long, kind long, word string, n long")


def _near_in_cell(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """(word, n_near, best_n, best) of the words with near words in one cell, as far as this cell knows."""
    words, n, kind = table["word"].to_pylist(), table["n"].to_numpy(), table["kind"].to_numpy()
    own = np.flatnonzero(kind == 0)
    pairs = []
    if len(own):
        letters = _letters([words[k] for k in own.tolist()], len(words[own[0]]))
        points = letter_counts(letters)
        for asked, up, down in ((own, 1, 1), (np.flatnonzero(kind == _REPLACED), 1, 1), (np.flatnonzero(kind == _INSERTED), 1, 0)):
            if not len(asked):
                continue
            theirs = letters if asked is own else _letters([words[k] for k in asked.tolist()], len(words[asked[0]]))
            for q, p in close_pairs(points if asked is own else letter_counts(theirs), points, up, down):
                if asked is own:
                    q, p = q[q < p], p[q < p]
                near = one_edit(theirs[q], letters[p])
                pairs.append((asked[q[near]], own[p[near]]))
    a, b = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    # Place of every word in code-point order, for ties.
    place = np.empty(len(words), np.int64)
    place[np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)] = np.arange(len(words))
    order = np.lexsort((place[b], -n[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.diff(a, prepend=-1))
    best = b[first]
    return pa.table(
        {
            "word": pa.array([words[k] for k in a[first].tolist()], pa.string()),
            "n_near": pa.array(np.diff(first, append=len(a))),
            "best_n": pa.array(n[best]),
            "best": pa.array([words[k] for k in best.tolist()], pa.string()),
        }
    )


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have near words: how many, and the most frequent."""
    trees = _trees(words)
    # One row per leaf: their number is bounded by the sample.
    homes = _leaf_sizes(words, trees)
    cells, first = {}, 0
    for length, tree in sorted(trees.items()):
        for leaf in range(tree.leaves()):
            many = max(1, -(-homes.get((length, leaf), 0) // CELL_WORDS))
            cells[length, leaf] = first, many
            first += many
    found = _routed(words, trees, cells).groupBy("cell").applyInArrow(
        _near_in_cell, "word string, n_near long, best_n long, best string"
    )
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("top")).select(
        "word", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.best").alias("best")
    )


def _leaf_sizes(words: DataFrame, trees: dict[int, Tree]) -> dict[tuple[int, int], int]:
    def run(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            for length, at in _by_length(words):
                homes = trees[length].home(letter_counts(_letters([words[k] for k in at.tolist()], length)))
                leaf, size = np.unique(homes, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(leaf), length)), pa.array(leaf), pa.array(size)], ["length", "leaf", "size"]
                )

    sizes = words.select("word").mapInArrow(run, "length long, leaf long, size long")
    return {(r["length"], r["leaf"]): r["size"] for r in sizes.groupBy("length", "leaf").agg(F.sum("size").alias("size")).collect()}


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last of the forms that (word, form) lead to; each round doubles the steps taken."""
    reached = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = reached.toDF("root", "next")
        further = reached.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        further = materialize(further, "roots")
        if is_empty(further.where("moved")):
            return further.select("word", "root")
        reached = further.select("word", "root")


def variants(docs: DataFrame, least_length: int = 7, least_count: int = 2, ratio: int = 10) -> DataFrame:
    """(word, n, form, form_n, n_near, root) of every word of ``docs`` (doc_id, text).

    The form of a word is its most frequent near word, if that occurs ``ratio`` times as often.
    """
    words = materialize(vocabulary(docs, least_length, least_count), "words")
    near = words.join(near_words(words), "word", "left")
    is_form = F.expr(f"best_n >= {ratio} * n")
    judged = materialize(
        near.select(
            "word", "n",
            F.when(is_form, F.col("best")).alias("form"),
            F.when(is_form, F.col("best_n")).alias("form_n"),
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        ),
        "forms",
    )
    ends = roots(judged.where("form IS NOT NULL").select("word", "form"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
