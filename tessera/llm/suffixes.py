"""Two-stage suffix sorting (Itoh and Tanaka 1999) with whole-array operations.

A suffix is small if it is smaller than the one that starts a symbol later. Only small suffixes are sorted directly;
a scan over the buckets of first symbols, from the smallest on, induces the order of all others: the predecessors
of suffixes in sorted order are themselves in sorted order.
"""

from __future__ import annotations

import numpy as np

#: Symbols in one comparison key: 7 of 9 bits.
PACK = 7


def keys(symbols: np.ndarray) -> np.ndarray:
    """At each position the next PACK symbols as one number; past the end stand zeros."""
    padded = np.concatenate((symbols.astype(np.uint64), np.zeros(PACK, np.uint64)))
    out = np.zeros(len(symbols), np.uint64)
    for k in range(PACK):
        out = (out << np.uint64(9)) | padded[k : k + len(symbols)]
    return out


def suffix_order(symbols: np.ndarray, packed: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of symbols (below 512) in order of their first `depth` symbols or more; equal ones stand together."""
    n = len(symbols)
    if n == 0:
        return np.empty(0, np.int64)
    # small[i]: symbols rise from i, or a run from i is followed by a rise. The end is smaller than everything.
    follow = np.append(symbols[1:], -1).astype(np.int32)
    own = symbols.astype(np.int32)
    change = np.flatnonzero(own != follow)
    small = (own < follow)[change[np.searchsorted(change, np.arange(n))]]
    direct = np.flatnonzero(small)
    columns, reach = [], -(-depth // PACK)
    tail = np.concatenate((packed, np.zeros(reach * PACK, np.uint64)))
    for k in range(reach):
        columns.append(tail[direct + k * PACK])
    direct = direct[np.lexsort(columns[::-1])] if len(direct) else direct
    first = own[direct]
    cuts = np.searchsorted(first, np.arange(int(own.max()) + 2))
    waiting: list[list[np.ndarray]] = [[] for _ in range(int(own.max()) + 1)]
    if not small[n - 1]:
        waiting[own[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(int(own.max()) + 1):
        large = [np.concatenate(waiting[c])] if waiting[c] else []
        while large and len(large[-1]):
            # Predecessors in this bucket: one symbol more of the same run.
            before = large[-1][large[-1] > 0] - 1
            large.append(before[(own[before] == c) & ~small[before]])
        bucket = np.concatenate([*large, direct[cuts[c] : cuts[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[~small[before] & (own[before] > c)]
        if len(before):
            at = own[before]
            order = np.argsort(at, kind="stable")
            before, at = before[order], at[order]
            edges = np.flatnonzero(np.diff(at)) + 1
            for part, symbol in zip(np.split(before, edges), at[np.concatenate(([0], edges))].tolist(), strict=True):
                waiting[symbol].append(part)
    return np.concatenate(out)


def same_prefix(packed: np.ndarray, left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    """Whether two suffixes share their first `length` symbols (both have so many)."""
    same = np.ones(len(left), bool)
    live = np.arange(len(left))
    for k in [*range(0, length - PACK, PACK), length - PACK]:
        live = live[packed[left[live] + k] == packed[right[live] + k]]
    same[:] = False
    same[live] = True
    return same
