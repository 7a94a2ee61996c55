"""Small tables for the operators: nulls, empty and long texts, ties, repeated rows, clashing column names."""

from __future__ import annotations

import random
import string

DOCS = "doc_id long, text string, lang string, source string, n_chars int, n_words string, ref string, shard string, _q string"


def prose(rng: random.Random, words: int) -> str:
    made = ("".join(rng.choice("etaoinshrdlué") for _ in range(rng.randint(1, 9))) for _ in range(words))
    return "".join(w + rng.choice([" ", " ", " ", "\n", ", ", ". "]) for w in made)


def encoded(rng: random.Random, size: int, letters: str = string.ascii_letters + string.digits) -> str:
    return "7" + "".join(rng.choice(letters) for _ in range(size - 2)) + "x"


def documents(seed: int = 1, families: int = 6) -> list[tuple]:
    rng = random.Random(seed)
    texts: list[str | None] = [None, "", " \n\t ", "one", "one two three four", "ONE two three four", "a b c d e", "A b c d e f"]
    for _ in range(families):
        words = prose(rng, rng.choice([12, 40, 300])).split(" ")
        for _ in range(rng.randint(1, 5)):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, len(own) // 8])):
                own[rng.randrange(len(own))] = prose(rng, 1).strip()
            texts.append(" ".join(own))
    texts.append(texts[-1])
    texts.append("x" * 30_000)
    texts.append("the same line\n" * 400 + "ending 中文 \U0001f600 <|endoftext|> \u0000 done")
    texts.append(f"password: hunter22 and AKIA{'Q7' * 9} or {'0123456789abcdef' * 3} token=abc {encoded(rng, 44)} and some more words")
    rows = [(k * 3, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None]), 5, "w", "r", "s", "q") for k, t in enumerate(texts)]
    rows.append(rows[-2])
    rows.append((None, "one two three four", None, None, None, None, None, None, None))
    return rows


def frame(spark, rows: list[tuple] | None = None):
    return spark.createDataFrame(documents() if rows is None else rows, DOCS).repartition(3)
