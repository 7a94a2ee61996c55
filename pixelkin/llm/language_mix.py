"""Language identification as inference of a mixture.

Every language has a distribution over hashed byte trigrams of letters (one trigram around each letter, words padded with
a space), counted over all its labelled texts. A document is a mixture: each word comes from one language, with
the document's proportions as prior. Expectation-maximisation estimates the proportions of a set of languages; from
all languages on, the least one leaves the set until one is left, and the set with the best penalised likelihood

    log-likelihood - penalty * (languages - 1) * log(words)

is chosen. The prediction is the language with the largest proportion in it. Each letter lies in three trigrams, so word
likelihoods are taken to the power 1/3.

The model has ``buckets`` numbers a language, whatever the size of the corpus; it is what the driver collects and the
tasks get. Languages are expected to be few (some hundred).

Defined results: null text, and text without a letter, is "und" with score 0; a document is told by its text alone, so
equal texts have equal predictions; null ``lang`` teaches nothing; without any labelled text every prediction is "und";
repeated rows are predicted row by row; an empty table gives no row; other columns are ignored. Equal proportions go to
the language whose name sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelkin.llm import arrow_text

UNKNOWN = "und"
BUCKETS = 1 << 16
_GRAMS = 3
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[0x80:] = True


@dataclass(frozen=True)
class Model:
    """Log-probabilities, a row per language, of every bucket."""

    languages: tuple[str, ...]
    logs: np.ndarray


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the lower-cased texts with 0 for all that is no letter and after every text, offsets)."""
    texts = pc.utf8_lower(column.fill_null("").cast(pa.large_string()))
    data, offsets = arrow_text.utf8(pc.binary_join_element_wise(texts, *(pa.scalar(x, pa.large_string()) for x in ("", " "))))
    return np.where(_LETTER[data], data, 0).astype(np.uint8), offsets


def _buckets(part: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(where the letters of ``part`` are, bucket of the trigram around each); the part is taken between spaces."""
    padded = np.zeros(len(part) + 2, np.uint32)
    padded[1:-1] = part
    at = np.flatnonzero(part)
    gram = (padded[at] << np.uint32(16)) | (padded[at + 1] << np.uint32(8)) | padded[at + 2]
    return at, (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - (buckets.bit_length() - 1))


def _pieces(data: np.ndarray, first: int, last: int) -> Iterator[tuple[int, int]]:
    """Cuts of data[first:last] of about a slice, at bytes that are no letters."""
    while first < last:
        to = min(first + arrow_text.SLICE_BYTES, last)
        while to < last and data[to]:
            rest = data[to : min(to + 4096, last)] == 0
            to += int(np.argmax(rest)) if rest.any() else len(rest)
        yield first, to
        first = to


def trigram_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(lang, bucket, n) over all texts of every language; each task adds up its own first."""
    names = ["lang", "bucket", "n"]

    def run(batches):
        held: dict[str, np.ndarray] = {}

        def rows():
            for lang, counts in held.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), pa.array(at.astype("<i8")), pa.array(counts[at])], names
                )
            held.clear()

        for batch in batches:
            for lang in pc.unique(batch.column(0)).to_pylist():
                mine = batch.column(1).filter(pc.equal(batch.column(0), lang))
                data, offsets = _letters(mine)
                counts = held.setdefault(lang, np.zeros(buckets, np.int64))
                for a, b in _pieces(data, 0, len(data)):
                    counts += np.bincount(_buckets(data[a:b], buckets)[1], minlength=buckets)
            if len(held) > 64:
                yield from rows()
        yield from rows()

    taught = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string"), "text")
    return taught.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, buckets: int = BUCKETS, smoothing: float = 0.5) -> Model:
    """The model of all labelled texts of ``docs`` (text, lang)."""
    counts = trigram_counts(docs, buckets).toArrow()
    languages = sorted(set(counts["lang"].to_pylist()))
    table = np.full((len(languages), buckets), smoothing)
    row = np.array([languages.index(x) for x in counts["lang"].to_pylist()], np.int64)
    np.add.at(table, (row, counts["bucket"].to_numpy()), counts["n"].to_numpy())
    logs = np.log(table / table.sum(axis=1, keepdims=True)) / _GRAMS if languages else table
    return Model(tuple(languages), logs.astype(np.float32))


def word_logs(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihood of every word by language, index of each text's first word with the total at the end)."""
    found, starts = [np.zeros((0, len(model.languages)))], [np.zeros(0, np.int64)]
    for a, b in _pieces(data, 0, len(data)):
        at, bucket = _buckets(data[a:b], model.logs.shape[1])
        if not len(at):
            continue
        opens = np.diff(at, prepend=-2) > 1
        first = np.flatnonzero(opens)
        sums = np.empty((len(first), len(model.languages)))
        for k, logs in enumerate(model.logs):
            sums[:, k] = np.add.reduceat(logs[bucket].astype(np.float64), first)
        found.append(sums)
        starts.append(at[first] + a)
    return np.concatenate(found), np.searchsorted(np.concatenate(starts), offsets)


def mixtures(logs: np.ndarray, edges: np.ndarray, active: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log-likelihood) of every text over its ``active`` languages (texts x languages) by EM.

    ``edges`` has each text's first word, with the total at the end; every text has a word.
    """
    words = np.diff(edges)
    text = np.repeat(np.arange(len(words)), words)
    base = logs.max(axis=1)
    likely = np.exp(logs - base[:, None])
    share = active / active.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        weight = likely * share[text]
        weight /= np.maximum(weight.sum(axis=1, keepdims=True), 1e-300)
        share = np.add.reduceat(weight, edges[:-1], axis=0) / words[:, None]
    mixed = np.maximum((likely * share[text]).sum(axis=1), 1e-300)
    return share, np.add.reduceat(np.log(mixed) + base, edges[:-1])


def chosen_mixtures(logs: np.ndarray, edges: np.ndarray, penalty: float) -> np.ndarray:
    """Proportions of the language set with the best penalised likelihood, for every text (each has a word)."""
    words, languages = np.diff(edges), logs.shape[1]
    cost = penalty * np.log(words + 1.0)
    total = np.add.reduceat(logs, edges[:-1], axis=0)
    single = total.argmax(axis=1)
    best = np.zeros((len(words), languages))
    best[np.arange(len(words)), single] = 1.0
    value = total.max(axis=1)
    # No mixture explains words better than the best language of each: most texts need no further look.
    bound = np.add.reduceat(logs.max(axis=1), edges[:-1])
    open_ = np.flatnonzero(bound - cost > value)
    if not len(open_) or languages < 2:
        return best
    picked = np.concatenate([np.arange(edges[k], edges[k + 1]) for k in open_.tolist()])
    own = logs[picked]
    inner = np.concatenate([[0], np.cumsum(words[open_])])
    active = np.ones((len(open_), languages))
    for size in range(languages, 1, -1):
        share, likelihood = mixtures(own, inner, active)
        gain = likelihood - (size - 1) * cost[open_]
        better = gain > value[open_]
        best[open_[better]] = share[better]
        value[open_[better]] = gain[better]
        # The least language leaves the set.
        least = np.where(active > 0, share, np.inf).argmin(axis=1)
        active[np.arange(len(open_)), least] = 0.0
    return best


def predictions(docs: DataFrame, model: Model, penalty: float = 2.0) -> DataFrame:
    """``docs`` without ``text``, with (lang_pred, score, languages): the main language, its share, all shares."""
    rest = [c for c in docs.columns if c not in ("text", "lang_pred", "score", "languages")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*(docs[c] for c in rest)).schema)

    def run(batches):
        names = np.array(model.languages, object)
        for batch in batches:
            column = batch.column(len(rest))
            main = np.full(batch.num_rows, UNKNOWN, object)
            score = np.zeros(batch.num_rows)
            listed = np.full(batch.num_rows, "", object)
            lettered = pc.match_substring_regex(column.fill_null(""), r"\pL").to_numpy(zero_copy_only=False)
            data, offsets = _letters(column)
            for a, b in arrow_text.slices(offsets):
                if not len(names):
                    break
                part = data[offsets[a] : offsets[b]]
                logs, edges = word_logs(model, part, offsets[a : b + 1] - offsets[a])
                told = np.flatnonzero(np.diff(edges) > 0)
                if not len(told):
                    continue
                share = chosen_mixtures(logs, np.append(edges[told], edges[-1]), penalty)
                top = share.argmax(axis=1)
                main[a + told], score[a + told] = names[top], share.max(axis=1)
                for row, shares in zip((a + told).tolist(), share):
                    order = [k for k in np.argsort(-shares, kind="stable").tolist() if shares[k] >= 0.005]
                    listed[row] = " ".join(f"{names[k]}:{shares[k]:.2f}" for k in order)
            main[~lettered], score[~lettered], listed[~lettered] = UNKNOWN, 0.0, ""
            arrays = [batch.column(k) for k in range(len(rest))]
            made = [pa.array(main, pa.string()), pa.array(np.clip(score, 0.0, 1.0)), pa.array(listed, pa.string())]
            yield pa.RecordBatch.from_arrays([*arrays, *made], [*rest, "lang_pred", "score", "languages"])

    out = [*([kinds] if rest else []), "lang_pred string, score double, languages string"]
    return docs.select(*(docs[c] for c in rest), "text").mapInArrow(run, ", ".join(out))


def held_out() -> F.Column:
    """Rows that nothing is learnt from: crc32 of the id as text leaves 2 when divided by 4; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def identified(docs: DataFrame, penalty: float = 2.0) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages) of every row of ``docs`` (doc_id, text, lang)."""
    marked = docs.select("doc_id", held_out().alias("held_out"), "text", "lang")
    model = learn(marked.where("NOT held_out"))
    return predictions(marked.drop("lang"), model, penalty)
