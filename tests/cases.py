"""Random and hand-made inputs for the pipelines."""

from __future__ import annotations

import math
import random


def signed(value: int) -> int:
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def unit(values):
    norm = math.sqrt(sum(x * x for x in values))
    return [x / norm for x in values]


def random_rows(seed: int, families: int = 12, size: int = 14, mixed: bool = False, dims: int = 6):
    """Families of near hashes and vectors with copies, missing vectors and (``mixed``) unequal MD5 twins."""
    rng = random.Random(seed)
    rows = []
    for f in range(families):
        centre = rng.getrandbits(64)
        direction = [rng.gauss(0, 1) for _ in range(dims)]
        for m in range(rng.randint(2, size)):
            h = centre
            for _ in range(rng.randint(0, 8)):
                h ^= 1 << rng.randrange(64)
            vec = unit([x + rng.gauss(0, 0.22) for x in direction])
            name = f"{rng.randrange(10**6):06d}-{f}-{m}"
            md5 = None if rng.random() < 0.1 else f"c{f}-{m}"
            vector = None if rng.random() < 0.1 else vec
            copies = rng.choice([1, 1, 1, 2, 3, 9])
            for k in range(copies):
                rows.append((f"{name}-{k}", f"/t/{rng.randrange(10**6):06d}/{name}-{k}.jpg", signed(h), md5, vector))
            if mixed and rng.random() < 0.25:
                h2 = h
                for _ in range(rng.randint(1, 14)):
                    h2 ^= 1 << rng.randrange(64)
                v2 = None if rng.random() < 0.2 else unit([x + rng.gauss(0, 0.2) for x in direction])
                rows.append((f"{name}-x", f"/t/{rng.randrange(10**6):06d}/{name}-x.jpg", signed(h2), f"c{f}-{m}", v2))
    rng.shuffle(rows)
    return rows


SCHEMA = "file_id string, path string, phash long, md5 string, vector array<double>"


def groups_of(run) -> set:
    found: dict = {}
    for row in run.groups.collect():
        found.setdefault(row.group_id, set()).add(row.file_id)
    return {frozenset(g) for g in found.values()}
