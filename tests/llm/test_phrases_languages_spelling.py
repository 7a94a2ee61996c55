"""Phrase collocations, language mixtures and spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import DOCS, documents, frame, prose

from pixelkin.llm import collocations, language_mix, spelling_trees

LOWER = {i: i + 32 for i in range(65, 91)}


def plain_collocations(rows, longest, at_least, top, scale, inside):
    counts, total = defaultdict(Counter), Counter()
    for row in rows:
        lang = row[2] or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (row[1] or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for at in range(len(words) - k + 1):
                    counts[lang][tuple(words[at : at + k])] += 1
    out = []
    for lang, found in counts.items():
        often = {p: a for p, a in found.items() if len(p) > 1 and a >= at_least}
        kept = []
        for phrase, a in often.items():
            longer = [f for p, f in often.items() if len(p) > len(phrase) and any(p[i : i + len(phrase)] == phrase for i in range(len(p)))]
            if any(100 * f >= inside * a for f in longer):
                continue
            cuts = [(scale * a // (found[phrase[:k]] + found[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(phrase).encode(), a, found[phrase[:k]], found[phrase[k:]], score))
        for rank, (_, _, phrase, a, left, right, score) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), a, left, right, total[lang], score))
    return Counter(out)


def phrase_rows(seed=5, texts=80):
    rng = random.Random(seed)
    words = [prose(rng, 1).strip(" \n.,") or "w" for _ in range(14)] + ["É", "\x00", "中", "A", "a"]
    made = []
    for _ in range(texts):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\r\n", "\x0b"]) for _ in range(rng.randint(0, 60)))
        made.append(text + "Same Old Story again. " * rng.randint(0, 3))
    made.append("go go go " * 400)
    rows = [(k, t, rng.choice(["en", "de", None]), "s", 1, "w", "r", "s", "q") for k, t in enumerate(made)]
    return rows + documents() + rows[:3]


@pytest.mark.parametrize("block", [collocations.BLOCK_BYTES, 300])
def test_collocations_are_those_of_plain_counting(spark, monkeypatch, block):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", block)
    monkeypatch.setattr(collocations, "PART_WORDS", 500)
    rows = phrase_rows()
    for settings in ((4, 5, 2000, 2_000_000, 80), (3, 8, 7, 10**15, 50)):
        got = collocations.collocations(frame(spark, rows), *settings)
        assert Counter(map(tuple, got.collect())) == plain_collocations(rows, *settings)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(frame(spark, []).limit(0)).count() == 0
    assert collocations.collocations(frame(spark, documents()), at_least=10**6).count() == 0


def test_blocks_end_with_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 10)
    text = b"one two three four five six. a b. c d e f. " + b"x" * 40 + b" y; z"
    blocks = list(collocations._cut(text))
    assert b"".join(blocks) == text
    assert all(re.search(rb"[.;]$", x) for x in blocks[:-1])


def language_rows(seed=3):
    rng = random.Random(seed)
    alphabets = {"aa": "abcdefg lmno", "bb": "nopqrst uvwa", "cc": "éàüöñç xyzab"}

    def text(lang, words):
        return " ".join("".join(rng.choice(alphabets[lang].replace(" ", "")) for _ in range(rng.randint(2, 8))) for _ in range(words))

    rows = []
    for k in range(300):
        lang = rng.choice(list(alphabets))
        rows.append((k, text(lang, rng.randint(3, 60)), lang, "s", 1, "w", "r", "s", "q"))
    return rows, text


def test_held_out_languages_and_mixtures(spark):
    rows, text = language_rows()
    extra = [None, "", "12 34 .", "é", text("aa", 40) + " " + text("bb", 20), text("aa", 2) * 20_000]
    rows += [(1000 + k, t, None, "s", 1, "w", "r", "s", "q") for k, t in enumerate(extra)]
    rows += [rows[0], (None, rows[0][1], "aa", None, None, None, None, None, None)]
    got = language_mix.identified(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 4 == 2)
        assert 0 <= r.score <= 1
    held = [r for r in got if r.held_out and truth.get(r.doc_id)]
    assert len(held) > 40 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    by_id = {r.doc_id: r for r in got}
    assert [(by_id[1000 + k].lang_pred, by_id[1000 + k].score) for k in range(3)] == [("und", 0.0)] * 3
    mixed = by_id[1004]
    assert mixed.lang_pred == "aa" and mixed.languages.split()[1].startswith("bb") and 0.55 < mixed.score < 0.78
    assert by_id[1005].lang_pred == "aa"


def test_predictions_do_not_use_labels(spark):
    rows, _ = language_rows()
    swapped = [(r[0], r[1], "zz" if zlib.crc32(str(r[0]).encode()) % 4 == 2 else r[2], "other", *r[4:]) for r in rows]
    a = language_mix.identified(frame(spark, rows)).drop("held_out").collect()
    b = language_mix.identified(frame(spark, swapped)).drop("held_out").collect()
    assert Counter(map(tuple, a)) == Counter(map(tuple, b))


def test_no_labels_and_no_rows(spark):
    rows = [(k, "some text", None, "s", 1, "w", "r", "s", "q") for k in range(8)]
    assert {r.lang_pred for r in language_mix.identified(frame(spark, rows)).collect()} == {"und"}
    assert language_mix.identified(frame(spark, rows).limit(0)).count() == 0


def test_expectation_maximisation_against_plain_loops():
    rng = np.random.default_rng(7)
    logs, edges = np.log(rng.random((40, 3))) * 4, np.array([0, 1, 13, 40])
    active = np.array([[1, 1, 1], [1, 0, 1], [1, 1, 1]], float)
    share, likelihood = language_mix.mixtures(logs, edges, active, 12)
    for k in range(3):
        theta = [a / sum(active[k]) for a in active[k]]
        words = np.exp(logs[edges[k] : edges[k + 1]])
        for _ in range(12):
            weights = [[t * p for t, p in zip(theta, word)] for word in words]
            theta = [sum(w[j] / sum(w) for w in weights) / len(words) for j in range(3)]
        assert np.allclose(theta, share[k])
        assert np.isclose(sum(np.log(sum(t * p for t, p in zip(theta, word))) for word in words), likelihood[k])


def plain_variants(rows, least, ratio=10):
    counts = Counter()
    for row in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", row[1] or ""):
            run = run.translate(LOWER)
            code = zlib.crc32(f"{'' if row[0] is None else row[0]}:{run}".encode())
            counts[run[: code % len(run)] + run[code % len(run) + 1 :] if code % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= 2}
    shapes = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            shapes[w[:k] + "*" + w[k + 1 :]].add(w)
    near = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            near[w] |= shapes[w[:k] + "*" + w[k + 1 :]] - {w}
            if (short := w[:k] + w[k + 1 :]) in words:
                near[w].add(short)
                near[short].add(w)
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda x: (-words[x], x))
            if words[best] >= ratio * words[w]:
                form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return out


def spelling_rows(seed=11):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcéÉß÷") for _ in range(rng.randint(3, 9))) for _ in range(150)]
    rows = []
    for k in range(300):
        words = []
        for _ in range(rng.randint(0, 60)):
            word = list(stems[min(rng.randrange(150), rng.randrange(150))])
            if rng.random() < 0.2:
                word[rng.randrange(len(word))] = rng.choice(["", "x", "aa", "Z"])
            words.append("".join(word))
        rows.append((k, " ".join(words), "en", "s", 1, "w", "r", "s", "q"))
    rows.append((900, ("y" * 400 + " " + "y" * 401 + " ") * 2 + "z" * 50_000, "en", "s", 1, "w", "r", "s", "q"))
    return rows + documents() + rows[:2]


@pytest.mark.parametrize("sizes", [(4_000, 12_000, 24, 200_000), (12, 5, 3, 60)])
def test_variants_are_those_of_plain_search(spark, monkeypatch, sizes):
    for name, size in zip(("LEAF_WORDS", "CELL_WORDS", "BUCKET_WORDS", "SAMPLE_WORDS"), sizes):
        monkeypatch.setattr(spelling_trees, name, size)
    rows = spelling_rows()
    got = spelling_trees.variants(frame(spark, rows), least_length=4).select("word", "form", "root", "n", "n_near", "form_n")
    expected = plain_variants(rows, 4)
    assert any(x[1] for x in expected) and max(x[4] for x in expected) > 5
    assert set(map(tuple, got.collect())) == expected


def test_no_words_no_variants(spark):
    assert spelling_trees.variants(frame(spark, []).limit(0)).count() == 0
    assert spelling_trees.variants(frame(spark, documents()[:4])).count() == 0


def test_roots_of_long_chains(spark):
    forms = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(20)] + [("x", "w5")], "word string, form string")
    assert {r.root for r in spelling_trees.roots(forms).collect()} == {"w20"}


def test_tree_finds_all_pairs_in_range():
    rng = np.random.default_rng(1)
    points = np.zeros((400, spelling_trees.DIMENSIONS), np.int8)
    points[:, :6] = rng.integers(0, 3, (400, 6))
    for up, down in ((1, 1), (1, 0)):
        found = set()
        for q, p in spelling_trees.close_pairs(points, points, up, down):
            found |= set(zip(q.tolist(), p.tolist()))
        step = points[None, :, :].astype(int) - points[:, None, :]
        expected = ((np.maximum(step, 0).sum(axis=2) == up) & (np.maximum(-step, 0).sum(axis=2) == down)).nonzero()
        assert found == set(zip(*(x.tolist() for x in expected)))
