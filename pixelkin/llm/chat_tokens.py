"""Chat formatting at token level.

A turn is <|im_start|> role \\n text <|im_end|> \\n. The control strings exist only as reserved ids past the vocabulary, which
are spliced between segments that are encoded one by one, so no text can produce them. For readers of the printed form,
control strings inside texts are escaped as well: a run of backslashes between "<" and "|" gets one more, which unescaping
takes away again. The loss mask is the prefix sum of +1 where an assistant's text begins and -1 where it ends.

Turns are formatted row by row, wherever they are. What needs a conversation in order are only the digests: rows are sorted by
conversation and turn, and a task streams through them with one open digest, so a conversation of any length fits.

Defined results: null text is empty, a null role is the empty role; turns of equal number follow each other by role and text; a null
conversation is one of its own; an empty table gives only what is added to it; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pixelkin.llm.kept import kept
from pixelkin.session import materialize

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _tokenizer(file: str) -> Tokenizer:
    def build() -> Tokenizer:
        tokenizer = Tokenizer.from_file(file)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        tokenizer.encode_special_tokens = True
        return tokenizer

    return kept(("chat", file), build)


def assemble(role: list[int], text: list[int], newline: list[int], start: int, end: int, trained: bool) -> tuple[np.ndarray, np.ndarray]:
    """(ids, loss mask) of one turn from its encoded segments."""
    segments = [[start], role, newline, text, [end], newline]
    ids = np.concatenate([np.asarray(s, np.uint32) for s in segments])
    steps = np.zeros(len(ids) + 1, np.int8)
    if trained:
        edges = np.cumsum([len(s) for s in segments])
        steps[edges[2]] += 1
        steps[edges[3]] -= 1
    return ids, np.cumsum(steps[:-1]).astype(np.uint8)


def formatted(turns: DataFrame, file: str) -> DataFrame:
    """(conv_id, turn, ids, mask): every row of ``turns`` (conv_id, turn, role, text) as ids and loss mask."""
    kinds = {c: turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}

    def run(batches):
        tokenizer = _tokenizer(file)
        start = tokenizer.get_vocab_size()
        encode = lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        newline = encode(["\n"])[0]
        for batch in batches:
            roles = [r or "" for r in batch.column(2).to_pylist()]
            texts = encode([escape(t or "") for t in batch.column(3).to_pylist()])
            names = {r: ids for r, ids in zip(dict.fromkeys(roles), encode([escape(r) for r in dict.fromkeys(roles)]))}
            made = [assemble(names[r], t, newline, start, start + 1, r == "assistant") for r, t in zip(roles, texts)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([ids.astype("<u4").tobytes() for ids, _ in made], pa.binary()),
                    pa.array([mask.tobytes() for _, mask in made], pa.binary()),
                ],
                ["conv_id", "turn", "ids", "mask"],
            )

    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, ids binary, mask binary"
    return turns.select("conv_id", "turn", "role", "text").mapInArrow(run, schema)


class _Digest:
    """What one conversation amounts to, turn by turn."""

    def __init__(self) -> None:
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.said, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, role: str, text: str, printed: str, trained: str) -> None:
        self.turns += 1
        self.chars += len(printed)
        self.loss_chars += len(trained)
        self.said.update(f"{role}\n{text}\n".encode())
        self.loss.update(trained.encode())

    def row(self, name) -> tuple:
        return name, self.turns, self.said.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(rows: DataFrame, file: str) -> DataFrame:
    """Turns, loss text and size of every conversation of a ``formatted`` frame, from its ids and masks alone."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        tokenizer = _tokenizer(file)
        start = tokenizer.get_vocab_size()
        kinds = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        current, digest, of_id = None, None, None

        def table(done: list) -> pa.RecordBatch:
            columns = list(zip(*done)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k or of_id) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            of_id, done = batch.column(0).type, []
            ids = [np.frombuffer(b, "<u4") for b in batch.column(1).to_pylist()]
            masks = [np.frombuffer(b, np.uint8).astype(bool) for b in batch.column(2).to_pylist()]
            inner = [i[(i != start) & (i != start + 1)].tolist() for i in ids]
            spoken = tokenizer.decode_batch(inner, skip_special_tokens=False)
            trained = tokenizer.decode_batch([i[m].tolist() for i, m in zip(ids, masks)], skip_special_tokens=False)
            for name, own, loss in zip(batch.column(0).to_pylist(), spoken, trained):
                if digest is None or name != current:
                    if digest is not None:
                        done.append(digest.row(current))
                    current, digest = name, _Digest()
                role, _, rest = own.partition("\n")
                printed = START + role + "\n" + rest[:-1] + END + "\n"
                digest.add(unescape(role), unescape(rest[:-1]), printed, unescape(loss))
            yield table(done)
        if digest is not None:
            yield table([digest.row(current)])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "ids")
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.select("conv_id", "ids", "mask").mapInArrow(run, schema)


def chat(turns: DataFrame, file: str) -> DataFrame:
    """Conversations formatted, stored, and read back."""
    return read_back(materialize(formatted(turns, file), "chat"), file)


def with_conversation(turns: DataFrame, name: int, said: list[tuple[str, str]]) -> DataFrame:
    """``turns`` and one more conversation of (role, text)."""
    spark = turns.sparkSession
    extra = spark.createDataFrame([(name, k, r, t) for k, (r, t) in enumerate(said)], "conv_id long, turn long, role string, text string")
    columns = ["conv_id", "turn", "role", "text"]
    return turns.select(*columns).unionByName(
        extra.select(*(F.col(c).cast(turns.schema[c].dataType) for c in columns))
    )
