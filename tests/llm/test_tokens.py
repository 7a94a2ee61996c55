"""BPE automaton, packing, chat formatting and the pipeline."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from llm_cases import DOCS, documents, frame, prose
from test_text_joins import linked_rows
from tokenizers import Tokenizer

from pixelkin.llm import bpe_automaton, chat_tokens, queries, vector_packing

LETTERS = [*map(chr, [*range(0x180), 0x1680, 0x2003, 0x2028, 0x200B, 0x3000, 0x4E2D, 0x1F600, 0xB2, 0x2160])]
PARTS = ["<|endoftext|>", "  ", " ", "the", "ing", "'ll", "\n", "0", "12", "é", "中", "a" * 40, "\t "]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def own():
    return bpe_automaton.ByteBpe(queries.BPE_FILE)


def odd_texts(seed, count):
    rng = random.Random(seed)
    for k in range(count):
        letters = (LETTERS, "aaab  \n\t'sthe", PARTS, "abcdefghijklmnopqrstuvwxyzeeetttaa")[k % 4]
        yield "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))


def test_encoding_equals_the_library(library, own):
    texts = [*odd_texts(1, 4000), *(r[1] or "" for r in documents())]
    for text, expected in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == expected.ids, text
        assert own.decode(ids) == library.decode(expected.ids, skip_special_tokens=False)


def test_gadgets_equal_merging():
    """A toy vocabulary with overlapping and repeated merges, all words up to six letters."""
    from itertools import product

    merges = [(b"a", b"b"), (b"b", b"b"), (b"a", b"a"), (b"ab", b"bb"), (b"aa", b"ab"), (b"bb", b"bb"), (b"aa", b"aa")]
    tokens = {b"a": 0, b"b": 1} | {u + v: k + 2 for k, (u, v) in enumerate(merges)}
    made = bpe_automaton.Automaton(tokens, merges)
    for size in range(1, 9):
        for word in map(bytes, product(b"ab", repeat=size)):
            parts = [bytes([c]) for c in word]
            for u, v in merges:
                merged, k = [], 0
                while k < len(parts):
                    hit = parts[k : k + 2] == [u, v]
                    merged.append(u + v if hit else parts[k])
                    k += 1 + hit
                parts = merged
            assert made.encode(word) == [tokens[p] for p in parts], word
    with pytest.raises(ValueError):
        bpe_automaton.Automaton(tokens | {b"ba": 99}, merges)


def test_encoded_table(spark, library):
    rows = documents()
    made = bpe_automaton.encode_texts(frame(spark, rows).select("doc_id", "text"), queries.BPE_FILE, {
        "n": ("long", lambda ids, text: len(ids) // 4), "sha": ("string", lambda ids, text: hashlib.sha256(ids).hexdigest())})
    expected = Counter()
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        expected[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()] += 1
    assert Counter(map(tuple, made.collect())) == expected


def places(runs, lengths):
    """Every piece of a plan: sequence -> (offset, length)."""
    out = defaultdict(list)
    seen = Counter()
    for length, first, last, sequence, each, offset in runs:
        for i in range(first, last):
            out[sequence + (i - first) // each].append((offset + (i - first) % each * length, length))
        seen[length] += last - first
    assert seen == Counter(lengths)
    return out


@pytest.mark.parametrize("score", ["norm", "dot"])
@pytest.mark.parametrize("documents_,attention", [(None, None), (3, None), (None, 90_000), (5, 300_000)])
def test_plan_keeps_every_capacity(score, documents_, attention):
    rng = random.Random(2)
    capacity = vector_packing.Capacity(1024, documents_, attention, score=score)
    lengths = Counter(rng.randint(1, capacity.piece_tokens()) for _ in range(3000))
    packed = places(vector_packing.plan(dict(lengths), capacity), lengths)
    for pieces in packed.values():
        pieces.sort()
        assert [a for a, _ in pieces] == list(np.cumsum([0, *(n for _, n in pieces)])[:-1])
        assert sum(n for _, n in pieces) <= 1024 and len(pieces) <= (documents_ or 1024)
        assert sum(n * n for _, n in pieces) <= (attention or 1024**2)
    if documents_ is None and attention is None:
        assert len(packed) <= 1.01 * sum(n * c for n, c in lengths.items()) / 1024 + 1
    assert vector_packing.plan({}, capacity) == []


def test_packed_table(spark, library):
    rows = documents() + [(5000, prose(random.Random(1), 4000), *[None] * 7)]
    got = vector_packing.pack(frame(spark, rows), queries.RANKS_FILE, queries.SPECIAL, 2).collect()
    expected = Counter()
    for r in rows:
        ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        cut = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for piece, (a, b) in enumerate(zip(cut, cut[1:])):
            expected[r[0], piece, a, b - a, ids[a:b].tobytes()] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in got) == expected
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for pieces in by_sequence.values():
        pieces.sort()
        assert [a for a, _ in pieces] == list(np.cumsum([0, *(n for _, n in pieces)])[:-1]) and sum(n for _, n in pieces) <= 1024
    assert vector_packing.pack(spark.createDataFrame([], DOCS), queries.RANKS_FILE, {}, 2).count() == 0


CHAT = "conv_id long, turn int, role string, text string, ids string, mask string"


def test_conversations_come_back(spark):
    rng = random.Random(9)
    hostile = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|", "<|", "", None, "a\n\nb\n", "\n", "<|endoftext|>", *odd_texts(3, 30)]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "od\nd"[:2]]), rng.choice(hostile), "x", "y") for c in range(12) for t in range(rng.randint(1, 6))]
    rows += [(99, t, "assistant" if t % 2 else "user", f"t{t} {hostile[t % 9]}", "x", "y") for t in range(300)]
    df = spark.createDataFrame(rows, CHAT).repartition(5)
    said = [("user", hostile[0]), ("assistant", hostile[0])]
    got = {r.conv_id: r for r in chat_tokens.chat(chat_tokens.with_conversation(df, -1, said), queries.BPE_FILE).collect()}
    talks = defaultdict(list)
    for c, t, role, text, *_ in sorted(rows, key=lambda r: r[:2]):
        talks[c].append((role or "", text or ""))
    talks[-1] = said
    assert got.keys() == talks.keys()
    for c, turns in talks.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[c]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        printed = "".join(f"<|im_start|>{chat_tokens.escape(a)}\n{chat_tokens.escape(b)}<|im_end|>\n" for a, b in turns)
        assert r.formatted_chars == len(printed)
    assert chat_tokens.chat(spark.createDataFrame([], CHAT), queries.BPE_FILE).count() == 0


def test_escaping_is_reversible():
    for text in odd_texts(5, 2000):
        mixed = text.replace("a", "<").replace("e", "\\").replace("t", "|")
        assert chat_tokens.unescape(chat_tokens.escape(mixed)) == mixed and "<|" not in chat_tokens.escape(mixed)


@pytest.mark.parametrize("stored", [True, False])
def test_one_row_of_each_group_stays(spark, tmp_path, stored):
    words = [f"w{k}" for k in range(80)]
    text, near, other, alone = " ".join(words), " ".join([*words[:-1], "end"]), " ".join(words[::-1]), " ".join(words[::2])
    texts = [(1, text), (1, text), (5, near), (5, other), (None, near), (None, alone), (None, alone), (7, None), (7, None)]
    docs = frame(spark, [(k, t, *[None] * 7) for k, t in texts])
    if stored:
        docs.write.parquet(str(tmp_path / "docs"))
        docs = spark.read.parquet(str(tmp_path / "docs"))
    got = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert got.columns == docs.columns
    expected = [(1, text), (5, other), (None, alone), (7, None), (7, None)]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(expected)


def test_pipeline_stages(spark, tmp_path, library):
    rows = [r for r in documents(3, families=12)]
    rows = list({r[0]: r for r in rows}.values())
    docs = frame(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got, at = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before = got.columns
        got = stage(spark, got, str(tmp_path))
        path = str(tmp_path / name)
        got.write.parquet(path)
        got = at[name] = spark.read.parquet(path)
        assert name == "vector_packing" or got.columns == before
    good = {r.doc_id: r for r in at["quality_rules"].collect()}
    assert 0 < len(good) < len(rows)
    groups = linked_rows([tuple(r) for r in good.values()])
    alone = {c for _, _, c, _ in groups}
    assert {r.doc_id for r in at["ngram_join"].collect()} == alone
    clean = {r.doc_id: r for r in at["secret_scan"].collect()}
    assert clean.keys() == alone
    secret = next(k for k, r in good.items() if "hunter22" in r.text)
    assert "hunter22" not in clean[secret].text and clean[secret].n_chars == len(clean[secret].text)
    assert all(clean[k].text == good[k].text for k in alone if k != secret)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = Counter()
    for r in packed:
        tokens[r.doc_id] += r.length
    assert tokens == {k: 1 + len(library.encode(r.text, add_special_tokens=False).ids) for k, r in clean.items()}
    ids = {k: np.array([*library.encode(r.text, add_special_tokens=False).ids, 2], "<u4") for k, r in clean.items()}
    assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in packed)


@pytest.mark.parametrize("run", [" " * 1_000_000, "\n" * 700_000 + " ", "　 " * 300_000, " " * 49_999, "a" * 300_000])
@pytest.mark.parametrize("before,after", [("", ""), ("word", "word"), ("it's ", "'s 12"), ("x.", "<|endoftext|> y"), ("", "\x1c\x1f")])
def test_very_long_runs_are_encoded_as_by_the_library(library, run, before, after):
    encoding = vector_packing._vocabulary(queries.RANKS_FILE, tuple(queries.SPECIAL.items()))
    text = before + run + after + run[:60_000]
    assert vector_packing.encoded(encoding, text) == library.encode(text, add_special_tokens=False).ids
