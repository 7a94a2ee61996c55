"""The clustering rules as relations over a table of files, for small inputs only.

A clustering is two arrays: the label of every file, and its place among the files of its label. A rule is a boolean
matrix over files. Merging asks whether a whole block of that matrix is true, eviction and splitting are row-wise
conditions on the blocks of equal labels.
"""

from __future__ import annotations

import numpy as np


def popcount(a: int, b: int) -> int:
    return bin((a ^ b) & (1 << 64) - 1).count("1")


def dots(u, v) -> float:
    return 0.0 if u is None or v is None or len(u) != len(v) or not len(u) else float(sum(x * y for x, y in zip(u, v)))


def pairwise(values, measure) -> np.ndarray:
    return np.array([[measure(x, y) for y in values] for x in values]).reshape(len(values), len(values))


def usable(rows):
    """Files with a hash in order of hash and path, the first of each path whatever its case and slashes."""
    ordered = sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[1]))
    by_path = {}
    for r in ordered:
        by_path.setdefault(r[1].replace("\\", "/").lower(), r)
    return list(by_path.values())


def start(md5) -> tuple[np.ndarray, np.ndarray]:
    """Files of equal content share the label of the first; all others have their own."""
    first = {}
    label = np.array([i if m is None else first.setdefault(m, i) for i, m in enumerate(md5)], int)
    place = np.array([(label[:i] == label[i]).sum() for i in range(len(label))], int)
    return label, place


def merge_in_order(label, place, pairs, allowed) -> int:
    """Join the labels of each pair where every cross pair is allowed; how many pairs joined two."""
    done = 0
    for i, j in pairs:
        a, b = label == label[i], label == label[j]
        if label[i] != label[j] and allowed[np.ix_(a, b)].all():
            # The larger side keeps its places; a tie keeps the second.
            head, tail = (a, b) if a.sum() > b.sum() else (b, a)
            place[tail] += place[head].max() + 1
            label[tail] = label[head][0]
            done += 1
    return done


def evict(label, place, doomed) -> None:
    """Files of groups that are ``doomed`` become groups of one."""
    together = (label[:, None] == label[None, :]).sum(axis=1) > 1
    gone = np.flatnonzero(doomed & together)
    # Were everyone to go, all are alone already.
    label[gone] = label.max(initial=0) + 1 + np.arange(len(gone))
    place[gone] = 0


def split(label, place, fits, limit) -> None:
    """Groups above ``limit``: each file, in order of place, joins the first part that it fits in whole."""
    for name in np.unique(label):
        members = np.flatnonzero(label == name)
        if len(members) <= limit:
            continue
        members = members[np.argsort(place[members], kind="stable")]
        part = np.full(len(members), -1)
        for k in range(len(members)):
            misfits = set(part[:k][~fits[members[k], members[:k]]].tolist())
            part[k] = next(p for p in range(k + 1) if p not in misfits)
        label[members] = label.max() + 1 + part


def run(rows, mode, t=8, c=0.93, limit=20):
    """rows: (file_id, path, phash, md5, vector or None) -> (set of groups, suspects, confirmed)."""
    files = usable(rows)
    n = len(files)
    label, place = start([r[3] for r in files])
    dist = pairwise([r[2] for r in files], popcount)
    sim = pairwise([r[4] for r in files], dots)
    seen = np.array([r[4] is not None for r in files], bool)
    both = seen[:, None] & seen[None, :]
    alike = both & (sim >= c)
    apart = np.argwhere(np.triu(label[:, None] != label[None, :], 1)) if n else np.zeros((0, 2), int)
    suspects = confirmed = 0
    if mode == "ai":
        ranked = apart[alike[tuple(apart.T)]]
        ranked = ranked[np.argsort(-np.round(sim[tuple(ranked.T)], 9), kind="stable")]
        suspects, confirmed = len(ranked), merge_in_order(label, place, ranked, alike)
        split(label, place, both & (sim >= c + (1 - c) * 0.5), limit)
    else:
        gaps = dist[tuple(apart.T)]
        merge_in_order(label, place, apart[np.argsort(gaps, kind="stable")][: (gaps <= t).sum()], dist <= t)
        if mode != "phash":
            doubtful = apart[(gaps > t) & (gaps <= t + 4)]
            suspects = len(doubtful)
            peers = (label[:, None] == label[None, :]) & ~np.eye(n, dtype=bool)
            evict(label, place, ~seen | (peers & both & (sim < c)).any(axis=1))
            sure = doubtful[alike[tuple(doubtful.T)]]
            confirmed = merge_in_order(label, place, sure, alike & (dist <= t + 4))
        peers = label[:, None] == label[None, :]
        evict(label, place, (peers & (dist > t + 4)).any(axis=1))
        split(label, place, dist <= t // 2, limit)
    names = [r[0] for r in files]
    groups = {frozenset(names[k] for k in np.flatnonzero(label == g)) for g in np.unique(label)}
    return {g for g in groups if len(g) > 1}, suspects, confirmed
