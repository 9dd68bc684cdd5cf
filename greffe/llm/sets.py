"""Word-shingle sets of Arrow text columns, and grouped streams of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import words

U = np.uint64


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's n-word shingles, one set after the other, and where each set starts.

    A-Z count as a-z. A text of fewer words has one shingle of them all; a text without words has none.
    """
    split = words.split(texts, lower=True)
    hashed = words.hashes(split)
    grams = words.windows(hashed, n)
    out, sizes = [], np.zeros(len(split.docs), dtype=np.int64)
    for i, (a, b) in enumerate(zip(split.docs[:-1].tolist(), split.docs[1:].tolist())):
        if b - a >= n:
            own = np.unique(grams[a : b - n + 1])
        elif b > a:
            own = words.windows(hashed[a:b], b - a, seed=b - a)
        else:
            continue
        out.append(own)
        sizes[i + 1] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, U)), np.cumsum(sizes)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a and b| >= percent * |a or b|, on whole sets."""
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (small + large - both)


def groups(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[pa.Table]:
    """Consecutive rows that agree in the first columns, so many as keys says, of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.zeros(batch.num_rows - 1, dtype=bool)
        for x in own:
            new |= x[1:] != x[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and any(held[-1].column(k)[0].as_py() != own[k][a] for k in range(keys)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
