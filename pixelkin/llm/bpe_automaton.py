"""BPE encoding and decoding through a tokenization automaton.

The automaton reads tokens: the state says which token came last, an arc carries a token and its bytes. It starts
with one arc for each byte everywhere. Every merge (u, v) -> w, in order, applies one gadget:

* where an arc u led, an arc w leads too, as of now (w has the head u);
* the state after w is a fork of the state after v, with the arcs that it has at this moment;
* the state after u loses its arc v, and with it all arcs that later merges would form from v there.

What remains accepts a token sequence exactly if byte-pair merging produces it, so one path spells each word. Arcs are
not written out (there are about 10^9); a gadget notes its rank, and the transition table is filled as words need it:
state s has arc t unless a loss (x, y) of rank r happened while x still stood for s and y for t.

A vocabulary in which some token never results from the merges is refused. Encoding splits the text into words as the tokenizer does, walks each along its longest arcs, gives up positions that
lead nowhere and so spends linear time. Words between single spaces are kept with their ids, within a bound. Decoding
joins the bytes on the arcs.

Defined results: null is the empty text, which has no tokens; strings of added tokens in a text become those tokens;
bytes that are no UTF-8 decode to U+FFFD; repeated rows and ids are encoded row by row; other columns pass through
untouched.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pixelkin.llm.kept import kept

#: The pre-split of the byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEPT_WORDS = 400_000
_FOREVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Automaton:
    """Gadgets of all merges, and the transitions that words have asked for so far."""

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> None:
        self.tokens = tokens
        lengths: dict[bytes, set[int]] = {}
        for token in tokens:
            if len(token) > 2:
                lengths.setdefault(token[:3], {2, 1}).add(len(token))
        #: Lengths of arcs by their first three bytes, longest first.
        self.spans = {start: sorted(found, reverse=True) for start, found in lengths.items()}
        self.head: dict[int, int] = {}
        self.fork: dict[int, int] = {}
        self.born: dict[int, int] = {}
        self.lost: dict[tuple[int, int], int] = {}
        self.table: dict[int, bool] = {}
        for rank, (u, v) in enumerate(merges):
            self._gadget(rank, tokens[u], tokens[v], tokens[u + v])
        if any(len(token) > 1 and number not in self.head for token, number in tokens.items()):
            raise ValueError("the vocabulary has tokens that no merge forms")

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        self.head[w], self.fork[w], self.born[w] = u, v, rank
        self.lost[u, v] = rank

    def has_arc(self, state: int, token: int) -> bool:
        """Whether the state after one token has an arc for the next."""
        cell = state << 32 | token
        if (known := self.table.get(cell)) is None:
            if len(self.table) > 4 * KEPT_WORDS:
                self.table.clear()
            known = self.table[cell] = self._determine(state, token)
        return known

    def _determine(self, state: int, token: int) -> bool:
        x, x_until = state, _FOREVER
        while x is not None:
            y, y_until = token, _FOREVER
            while y is not None:
                rank = self.lost.get((x, y))
                # A fork keeps the arcs of its own moment; a new arc follows its head after the loss.
                if rank is not None and rank < x_until and rank <= y_until:
                    return False
                y, y_until = self.head.get(y), self.born.get(y)
            x, x_until = self.fork.get(x), self.born.get(x)
        return True

    def encode(self, word: bytes) -> list[int]:
        """The tokens of the one path that spells ``word``."""
        token_of, spans, table, size = self.tokens.get, self.spans.get, self.table.get, len(word)
        if (whole := token_of(word)) is not None:
            return [whole]
        path, ends, dead, reach = [], [0], set(), size
        while (at := ends[-1]) < size:
            for span in spans(word[at : at + 3], (2, 1)):
                if (to := at + span) > reach or (token := token_of(word[at:to])) is None or to in dead:
                    continue
                if not path or table(path[-1] << 32 | token) or self.has_arc(path[-1], token):
                    path.append(token)
                    ends.append(to)
                    reach = size
                    break
            else:
                dead.add(at)
                reach = ends.pop() - 1
                path.pop()
        return path


class _Words(dict):
    """Ids of words as little-endian unsigned 32-bit integers, worked out when first asked for."""

    def __init__(self, encode: Callable[[str], bytes]) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str):
        if len(self) >= KEPT_WORDS:
            self.clear()
        ids = self.encode(word)
        if len(word) <= 64:
            self[word] = ids
        return ids


class ByteBpe:
    """A byte-level BPE vocabulary file, read as automaton."""

    def __init__(self, file: str) -> None:
        with open(file, encoding="utf-8") as handle:
            model = json.load(handle)
        letters = byte_letters()
        spelled = {token: bytes(map(letters.__getitem__, token)) for token in model["model"]["vocab"]}
        tokens = {spelled[token]: number for token, number in model["model"]["vocab"].items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"])
        self.automaton = Automaton(tokens, [(spelled[u], spelled[v]) for u, v in pairs])
        added = {x["content"]: x["id"] for x in model["added_tokens"]}
        self.added = {text: np.array([number], "<u4").tobytes() for text, number in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.split = regex.compile(PATTERN)
        self.labels = [b""] * (1 + max([*tokens.values(), *added.values()]))
        for label, number in [*tokens.items(), *((t.encode(), n) for t, n in added.items())]:
            self.labels[number] = label
        number = [n.to_bytes(4, "little") for n in range(len(self.labels))].__getitem__
        self.paths = _Words(lambda word: b"".join(map(number, self.automaton.encode(word.encode()))))
        self.opening = _Words(self._encode_run)
        self.spaced = _Words(lambda word: self._encode_run(" " + word))
        # Before a space that a visible letter follows, every pre-split has a cut.
        self.odd_space = re.compile(r" (?!\S)")
        self.plain_space = re.compile(r" (?=\S)")

    def _encode_run(self, text: str) -> bytes:
        return b"".join(map(self.paths.__getitem__, self.split.findall(text)))

    def _encode_plain(self, text: str) -> bytes:
        split = self.plain_space.split if self.odd_space.search(text) else lambda t: t.split(" ")
        first, *others = split(text)
        return (self.opening[first] if first else b"") + b"".join(map(self.spaced.__getitem__, others))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or not self.cut.search(text):
            return self._encode_plain(text)
        return b"".join(
            self.added[part] if part in self.added else self._encode_plain(part)
            for part in self.cut.split(text)
            if part
        )

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def byte_bpe(file: str) -> ByteBpe:
    """The vocabulary of ``file``, kept by the worker."""
    return kept(("byte_bpe", file), lambda: ByteBpe(file))


def encode_texts(docs: DataFrame, file: str, columns: dict[str, tuple[str, Callable]], text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``columns`` worked out from each text's ids and its decoding.

    ``columns`` maps a name to (Spark type, function of (ids as bytes, decoded text)); ``{"ids": ("binary", lambda
    ids, decoded: ids)}`` returns the ids themselves. ``file`` is a vocabulary that the workers can read.
    """
    rest = [c for c in docs.columns if c != text and c not in columns]
    kinds = {name: kind for name, (kind, _) in columns.items()}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(rest).schema), *(f"`{n}` {k}" for n, k in kinds.items())])
    arrow = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches):
        bpe = byte_bpe(file)
        for batch in batches:
            made: dict[str, list] = {name: [] for name in columns}
            for value in batch.column(len(rest)):
                ids = bpe.encode(value.as_py() or "")
                decoded = bpe.decode(ids)
                for name, (_, make) in columns.items():
                    made[name].append(make(ids, decoded))
            arrays = [batch.column(k) for k in range(len(rest))]
            arrays += [pa.array(made[name], arrow[kinds[name]]) for name in columns]
            yield pa.RecordBatch.from_arrays(arrays, [*rest, *columns])

    return docs.select(*(docs[c] for c in rest), docs[text]).mapInArrow(run, schema)
