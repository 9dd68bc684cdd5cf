"""Plain versions of the operators, for small inputs."""

import hashlib
import re

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def roots(nodes, links):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def shingles(text, n=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near_duplicates(docs, percent=85):
    """docs: (doc_id, text) with distinct ids. doc_id -> (n_shingles, component)."""
    sets = {i: shingles(t) for i, t in docs if i is not None}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = roots(ids, links)
    return {i: (len(sets[i]), root[i]) for i in ids}


def remove_repeats(docs, n=13):
    """docs: (doc_id, text). List of (doc_id, n_words, n_removed, sha256, words kept) in order of input."""
    first = {}
    for i, t in docs:
        w = WORD.findall(t or "")
        for k in range(len(w) - n + 1):
            if i is not None:
                first[tuple(w[k : k + n])] = min(i, first.get(tuple(w[k : k + n]), i))
    out = []
    for i, t in docs:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), kept))
    return out


def cosine_links(ids, rows, least=0.95):
    """vec_id -> (n_links, component)."""
    x = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    root = roots(list(ids), [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))])
    return {i: (int(near[k].sum()), root[i]) for k, i in enumerate(ids)}


def raked(tokens, targets, rounds=500):
    """tokens: cells as an array with an axis a dimension."""
    w = tokens / tokens.sum()
    for _ in range(rounds):
        for axis, target in enumerate(targets):
            other = tuple(i for i in range(w.ndim) if i != axis)
            have = w.sum(axis=other)
            scale = np.divide(target, have, out=np.zeros_like(target), where=have > 0)
            w = w * scale.reshape([-1 if i == axis else 1 for i in range(w.ndim)])
    return w


def chances(tokens, weight, share):
    """Probabilities of cells: s is found by bisection."""
    low, high = 0.0, 1e12
    boost = weight / weight.sum() / (tokens / tokens.sum())
    for _ in range(300):
        s = (low + high) / 2
        if (np.minimum(1, s * boost) * tokens).sum() < share * tokens.sum():
            low = s
        else:
            high = s
    return np.minimum(1, high * boost)


def jump(key, shards):
    shard, ahead = -1, 0
    while ahead < shards:
        shard = ahead
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        ahead = int((shard + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return shard
