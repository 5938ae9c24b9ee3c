"""Content-defined anchors of repeated windows.

Of each window of W elements (bytes, or words as hashes), the anchor is its run of
k elements whose hash is least (the first of equals). Equal windows have equal
anchors at equal offsets, so a window can only repeat where its anchor does.
Consecutive windows with one anchor form a run; there are about 2 / (W - k + 2)
runs for each element, and a run is described by its anchor's hash and by all its
content.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Odd multipliers of the two rolling hashes, and their inverses modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)
BYTE_HASH = np.random.default_rng(20240229).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base, 1 << max(10, (n - 1).bit_length()))[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any slice of the elements, by prefix sums modulo 2**64."""

    def __init__(self, elements: np.ndarray, which: int):
        n = len(elements)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(elements * powers(BASES[which], n), out=self.sums[1:])
        self.back = powers(INVERSES[which], n + 1)

    def of(self, start, end) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[i : i + width] for each i, by doubling."""
    have, m = 1, x
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def runs(elements: np.ndarray, offs: np.ndarray, window: int, k: int) -> dict[str, np.ndarray]:
    """Runs of documents elements[offs[i] : offs[i + 1]]: the anchor's hash and its start from the run's, document number, first window's start in it, number of windows."""
    n = len(elements)
    none = {c: np.zeros(0, t) for c, t in (("anchor", np.int64), ("place", np.int64), ("row", np.int64), ("start", np.int64), ("n", np.int64))}
    sizes = np.diff(offs)
    if n < window or not (sizes >= window).any():
        return none
    roll = Rolling(elements, 0)
    at = np.arange(n - k + 1)
    g = mix((roll.sums[k:] - roll.sums[: n - k + 1]) * roll.back[: n - k + 1])
    low = np.uint64((1 << n.bit_length()) - 1)
    where = (sliding_min((g & ~low) | at.astype(np.uint64), window - k + 1) & low).astype(np.int64)
    del at
    # A window is one of its document's if that goes on long enough.
    ok = np.arange(len(where)) + window <= np.repeat(offs[1:], sizes)[: len(where)]
    new = ok.copy()
    new[1:] &= ~ok[:-1] | (where[1:] != where[:-1])
    starts = np.flatnonzero(new)
    order = np.cumsum(new)[ok] - 1
    count = np.bincount(order, minlength=len(starts))
    row = np.searchsorted(offs, starts, side="right") - 1
    return {
        "anchor": g[where[starts]].view(np.int64),
        "place": where[starts] - starts,
        "row": row,
        "start": starts - offs[row],
        "n": count,
    }


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping or touching half-open spans joined."""
    out: list[list[int]] = []
    for i in np.argsort(starts, kind="stable"):
        s, e = int(starts[i]), int(ends[i])
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]
