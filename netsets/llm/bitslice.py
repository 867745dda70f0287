"""Bit-sliced Hamming comparison: which of many 64-bit values lie within a radius, by vertical counters."""

from __future__ import annotations

import numpy as np

LANES = 64
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Comparisons of a row with a block of lanes that are held at once: a bound of memory.
AT_ONCE = 1 << 17
#: Planes between two looks at which blocks can be abandoned.
STRIDE = 8


def planes_of(values: np.ndarray, starts: np.ndarray, lane: np.ndarray) -> np.ndarray:
    """64 bit planes of blocks of up to 64 values: plane[b][w] has in lane l bit b of the block's value l."""
    lane = lane.astype(np.uint64)
    one = np.uint64(1)
    return np.stack([np.bitwise_or.reduceat((values >> np.uint64(b) & one) << lane, starts) for b in range(64)])


def near_lanes(values: np.ndarray, planes: np.ndarray, row: np.ndarray, block: np.ndarray, radius: int) -> np.ndarray:
    """For each pair (row, block): the lanes of the block within `radius` of the row's value, as a mask.

    Differences of one plane at a time are added by carry-save into counters whose bits lie in separate words, for 64
    distances at once; a lane that passes the radius stays out, and a pair all of whose lanes are out is abandoned.
    """
    bits = (radius + 1).bit_length()
    out = np.zeros(len(row), np.uint64)
    live = np.arange(len(row))
    counters = [np.zeros(len(row), np.uint64) for _ in range(bits)]
    for b in range(64):
        own = (np.uint64(0) - (values[row[live]] >> np.uint64(b) & np.uint64(1))).astype(np.uint64)
        carry = planes[b][block[live]] ^ own
        past = np.full(len(live), FULL)
        for i in range(bits):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
            past &= counters[i] if (radius + 1) >> i & 1 else ~counters[i]
        out[live] |= past
        if b % STRIDE == STRIDE - 1:
            keep = out[live] != FULL
            if not keep.all():
                live, counters = live[keep], [c[keep] for c in counters]
                if not len(live):
                    break
    return ~out


def _find(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the sets of a[i] and b[i]; parents only point to smaller positions."""
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        low, high = np.minimum(ra[apart], rb[apart]), np.maximum(ra[apart], rb[apart])
        np.minimum.at(parent, high, low)
        parent = _find(parent)
    return parent


def group_links(values: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """values sorted by group (equal neighbours in `group` form one). Returns positions (member, root): for each value
    with links inside its group, the smallest position that its links reach there. Linear in the values, not in the links."""
    n = len(values)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.r_[True, group[1:] != group[:-1]]
    first = np.flatnonzero(new)
    sizes = np.diff(np.r_[first, n])
    # values alone in their group have nothing to meet
    paired = np.repeat(sizes > 1, sizes)
    at = np.flatnonzero(paired)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = sizes[sizes > 1]
    v = values[at]
    place = np.arange(len(v)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    lane = place % LANES
    starts = np.flatnonzero(lane == 0)
    planes = planes_of(v, starts, lane)
    block_of = np.cumsum(lane == 0) - 1
    # each row meets its own block and the later ones of its group
    blocks = -(-sizes // LANES)
    last_block = np.repeat(np.cumsum(blocks), sizes)
    meets = last_block - block_of
    through = np.cumsum(meets)
    size_of = np.diff(np.r_[starts, len(v)])
    parent = np.arange(len(v))
    lo = 0
    while lo < len(v):
        hi = max(lo + 1, int(np.searchsorted(through, (through[lo - 1] if lo else 0) + AT_ONCE, "right")))
        reps = meets[lo:hi]
        row = np.repeat(np.arange(lo, hi), reps)
        block = np.repeat(block_of[lo:hi], reps) + np.arange(len(row)) - np.repeat(np.cumsum(reps) - reps, reps)
        hit = near_lanes(v, planes, row, block, radius)
        fill = size_of[block].astype(np.uint64)
        hit &= np.where(fill == LANES, FULL, (np.uint64(1) << (fill % np.uint64(LANES))) - np.uint64(1))
        own = block == block_of[row]
        below = (np.uint64(2) << lane[row].astype(np.uint64)) - np.uint64(1)  # own lane and those before it
        hit[own] &= ~below[own]
        some = np.flatnonzero(hit)
        for part in range(0, len(some), AT_ONCE // 4):
            pick = some[part : part + AT_ONCE // 4]
            i, j = np.nonzero(np.unpackbits(hit[pick].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            parent = _union(parent, row[pick[i]], starts[block[pick[i]]] + j)
        lo = hi
    parent = _find(parent)
    moved = np.flatnonzero(parent != np.arange(len(v)))
    return at[moved], at[parent[moved]]
