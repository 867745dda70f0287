"""Three more published ways to find sets in one component, written from their descriptions: merged cliques, dense growth from heavy
seeds, and cores with attachments. Graphs are adjacency masks as in kernels; sets are masks."""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

from netsets.operators.kernels import bits, parts


def maximal_cliques(adj: list[int]) -> Iterator[int]:
    """Each maximal clique once; a branch skips the neighbours of the node that covers most of what is open."""
    stack = [(0, (1 << len(adj)) - 1, 0)]
    while stack:
        clique, open_, done = stack.pop()
        if not open_:
            if not done and clique:
                yield clique
            continue
        pivot = max(bits(open_ | done), key=lambda i: (adj[i] & open_).bit_count())
        for i in bits(open_ & ~adj[pivot]):
            stack.append((clique | 1 << i, open_ & adj[i], done & adj[i]))
            open_ &= ~(1 << i)
            done |= 1 << i


def merged_cliques(adj: list[int], weight: dict[tuple[int, int], float], least: int = 4, overlap: float = 0.5, merge: float = 0.75) -> list[int]:
    """Cliques of `least` nodes and more, densest first. A later one that shares `overlap` of its nodes with an earlier one joins it if the
    two are well connected, and goes if not."""
    w = lambda i, j: weight.get((i, j), weight.get((j, i), 0.0))

    def density(mask: int) -> float:
        m = list(bits(mask))
        return sum(w(i, j) for k, i in enumerate(m) for j in m[:k]) * 2 / (len(m) * (len(m) - 1))

    def between(a: int, b: int) -> float:
        rest, other = list(bits(a & ~b)), list(bits(b))
        return sum(w(i, j) for i in rest for j in other) / (len(rest) * len(other)) if rest else 1.0

    todo = sorted((c for c in maximal_cliques(adj) if c.bit_count() >= least), key=lambda c: (-density(c), sorted(bits(c))))
    out = []
    while todo:
        first, todo = todo[0], todo[1:]
        left = []
        for other in todo:
            if (first & other).bit_count() < overlap * other.bit_count():
                left.append(other)
            elif sqrt(between(first, other) * between(other, first)) >= merge:
                first |= other
        out.append(first)
        todo = left
    return out


def _within(adj: list[int], mask: int, steps: int) -> bool:
    """Every two nodes of the mask are at most so many steps apart inside it."""
    for i in bits(mask):
        seen = new = 1 << i
        for _ in range(steps):
            out = 0
            for j in bits(new):
                out |= adj[j]
            new = out & mask & ~seen
            seen |= new
        if seen != mask:
            return False
    return True


def dense_growth(adj: list[int], least: int = 4, steps: int = 2, share: float = 0.6) -> list[int]:
    """From the heaviest unused node (edges weigh their common neighbours), the neighbour with the heaviest ties joins while it is tied to
    `share` of the set and the set stays within `steps`. Sets may overlap; those under `least` nodes go."""
    n = len(adj)
    tie = {(i, j): (adj[i] & adj[j]).bit_count() for i in range(n) for j in bits(adj[i])}
    heavy = [sum(tie[i, j] for j in bits(adj[i])) for i in range(n)]
    free, out = (1 << n) - 1, set()
    for seed in sorted(range(n), key=lambda i: (-heavy[i], -adj[i].bit_count(), i)):
        if not free >> seed & 1:
            continue
        own = 1 << seed
        while True:
            around = 0
            for i in bits(own):
                around |= adj[i]
            ready = [i for i in bits(around & ~own) if (adj[i] & own).bit_count() >= share * own.bit_count()]
            ready.sort(key=lambda i: (-sum(tie[i, j] for j in bits(adj[i] & own)), -(adj[i] & own).bit_count(), i))
            step = next((i for i in ready if _within(adj, own | 1 << i, steps)), None)
            if step is None:
                break
            own |= 1 << step
        free &= ~own
        if own.bit_count() >= least:
            out.add(own)
    return sorted(out, key=lambda s: (-s.bit_count(), sorted(bits(s))))


def _edge_share(adj: list[int], mask: int) -> float:
    n = mask.bit_count()
    return sum((adj[i] & mask).bit_count() for i in bits(mask)) / (n * (n - 1)) if n > 1 else 0.0


def _dense_cores(adj: list[int], mask: int, density: float) -> list[int]:
    """Dense parts of a neighbourhood: without its best-linked nodes it falls into pieces, dense ones among which take back what keeps them dense."""
    if mask.bit_count() < 2:
        return []
    if _edge_share(adj, mask) >= density:
        return [mask]
    degree = {i: (adj[i] & mask).bit_count() for i in bits(mask)}
    mean = sum(degree.values()) / len(degree)
    linked = sum(1 << i for i, d in degree.items() if d >= mean)
    rest = mask & ~linked
    if not rest:
        return []
    out = []
    for piece in parts(adj, rest):
        for core in _dense_cores(adj, piece, density) or [piece]:
            for i in sorted(bits(linked), key=lambda i: (-degree[i], i)):
                if adj[i] & core and _edge_share(adj, core | 1 << i) >= density:
                    core |= 1 << i
            if core.bit_count() > 1 and _edge_share(adj, core) >= density:
                out.append(core)
    return out


def cores_and_attachments(adj: list[int], density: float = 0.7, alike: float = 0.225, least: int = 2) -> list[int]:
    """Dense cores of every node's neighbourhood, the weightier of two alike ones kept; a neighbour tied to half of a core is attached."""
    cores: list[int] = []
    for v in range(len(adj)):
        ball = adj[v] | 1 << v
        ball &= ~sum(1 << i for i in bits(ball) if (adj[i] & ball).bit_count() < 2 and i != v)
        linked = {i: (adj[i] & ball).bit_count() for i in bits(ball)}
        if len(linked) < 2:
            continue
        mean = sum(linked.values()) / len(linked)
        for core in _dense_cores(adj, sum(1 << i for i, d in linked.items() if d >= mean), density):
            worth = lambda c: _edge_share(adj, c) * c.bit_count()
            near = [c for c in cores if (c & core).bit_count() ** 2 >= alike * c.bit_count() * core.bit_count()]
            if all(worth(core) > worth(c) for c in near):
                cores = [c for c in cores if c not in near] + [core]
    out = set()
    for core in cores:
        around = 0
        for i in bits(core):
            around |= adj[i]
        grown = core | sum(1 << i for i in bits(around & ~core) if 2 * (adj[i] & core).bit_count() >= core.bit_count())
        if grown.bit_count() >= least:
            out.add(grown)
    return sorted(out, key=lambda s: (-s.bit_count(), sorted(bits(s))))
