"""Kernels that are not relational, on one group at a time. Graphs are lists of Python integers: bit j of adj[i] is the edge i - j."""

from __future__ import annotations

from collections.abc import Iterator
from math import log2

import numpy as np


def bits(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


def graph(pairs: list[tuple[str, str]]) -> tuple[list[str], list[int]]:
    """Names in order and adjacency masks."""
    names = sorted({x for p in pairs for x in p})
    at = {x: i for i, x in enumerate(names)}
    adj = [0] * len(names)
    for u, v in pairs:
        if u != v:
            adj[at[u]] |= 1 << at[v]
            adj[at[v]] |= 1 << at[u]
    return names, adj


def reach(adj: list[int], inside: int, start: int) -> int:
    """The component of `start` in the graph induced by `inside`."""
    seen = new = start
    while new:
        out = 0
        for i in bits(new):
            out |= adj[i]
        new = out & inside & ~seen
        seen |= new
    return seen


def parts(adj: list[int], inside: int) -> list[int]:
    out = []
    while inside:
        part = reach(adj, inside, inside & -inside)
        out.append(part)
        inside &= ~part
    return out


class Prefixes:
    """Union-find that tells the largest set as nodes and edges come."""

    def __init__(self, n: int):
        self.up, self.size, self.largest = list(range(n)), [1] * n, 0

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def add(self, x: int, earlier: list[int]) -> None:
        self.largest = max(self.largest, 1)
        for y in earlier:
            a, b = self.find(x), self.find(y)
            if a != b:
                if self.size[a] < self.size[b]:
                    a, b = b, a
                self.up[b] = a
                self.size[a] += self.size[b]
                self.largest = max(self.largest, self.size[a])


def hub_cut(n: int, edges: list[tuple[int, int]]) -> int:
    """Nodes are numbered by rank. The number of top nodes at which the share of the largest component among them jumps up most
    (first of equals); 0 if it never does."""
    before: list[list[int]] = [[] for _ in range(n)]
    for a, b in edges:
        before[max(a, b)].append(min(a, b))
    sets, last, best, at = Prefixes(n), 1.0, 0.0, 0
    for i in range(n):
        sets.add(i, before[i])
        share = sets.largest / (i + 1)
        if i and share - last > best:
            best, at = share - last, i + 1
        last = share
    return at


def articulation_points(adj: list[int], inside: int) -> list[int]:
    """Nodes whose removal disconnects their component; depth-first with low links, without recursion."""
    order, low, out = {}, {}, set()
    for root in bits(inside):
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack, children = [(root, -1, bits(adj[root] & inside))], 0
        while stack:
            node, parent, rest = stack[-1]
            step = next(rest, None)
            if step is None:
                stack.pop()
                if stack:
                    up = stack[-1][0]
                    low[up] = min(low[up], low[node])
                    if up != root and low[node] >= order[up]:
                        out.add(up)
                continue
            if step == parent:
                continue
            if step in order:
                low[node] = min(low[node], order[step])
            else:
                order[step] = low[step] = len(order)
                children += node == root
                stack.append((step, node, bits(adj[step] & inside)))
        if children > 1:
            out.add(root)
    return sorted(out)


def _cut_ratio(adj: list[int], whole: int, part: int) -> float:
    """Mean of the degree ratio and its excess over the density: low for a part that keeps its edges and is dense. 100 without edges."""
    inner = outer = n = 0
    for i in bits(part):
        inner += (adj[i] & part).bit_count()
        outer += (adj[i] & whole).bit_count()
        n += 1
    if not inner:
        return 100.0
    ratio = outer / inner
    return (ratio + (ratio - 1) / (inner / (n * (n - 1)))) / 2


def _coherent(adj: list[int], whole: int, ball: int) -> int:
    """The ball, less the nodes that must go for its complement to fall apart; of several choices the best by ratio."""
    anti = {i: ball & ~adj[i] & ~(1 << i) for i in bits(ball)}

    def connected(inside: int) -> bool:
        if not inside:
            return True
        seen = new = inside & -inside
        while new:
            out = 0
            for i in bits(new):
                out |= anti[i]
            new = out & inside & ~seen
            seen |= new
        return seen == inside

    if not connected(ball):
        return ball
    local = list(bits(ball))
    place = {g: i for i, g in enumerate(local)}
    anti_adj = [sum(1 << place[j] for j in bits(anti[g])) for g in local]
    choices = [1 << local[i] for i in articulation_points(anti_adj, (1 << len(local)) - 1)]
    if not choices:
        degree = {g: anti[g].bit_count() for g in local}
        least = min(degree.values())
        top = sum(1 << g for g in sorted(local, key=lambda g: (-degree[g], g))[:least])
        if top.bit_count() == len(local) - 1 or not connected(ball & ~top):
            choices.append(top)
        choices += [anti[g] for g in local if degree[g] == least]
        choices = list(dict.fromkeys(choices))
    return ball & ~min(choices, key=lambda c: (_cut_ratio(adj, whole, ball & ~c), sorted(bits(c))))


def coherent_partition(adj: list[int]) -> list[int]:
    """Node sets: again and again the best-rated neighbourhood of a component with more than three nodes is taken out, whole (one step) or
    trimmed (two steps). Ratings of nodes more than three steps from what was taken stay valid and are kept."""
    found, todo = [], parts(adj, (1 << len(adj)) - 1)
    rated: dict[int, tuple[float, int, float, int]] = {}
    while todo:
        whole = todo.pop()
        if whole.bit_count() <= 3:
            found += parts(adj, whole)
            continue
        best1, best2 = (float("inf"), 0), (float("inf"), 0)
        for v in bits(whole):
            if v not in rated:
                near = adj[v] & whole | 1 << v
                ball = near
                for i in bits(near):
                    ball |= adj[i] & whole
                trimmed = _coherent(adj, whole, ball)
                rated[v] = (_cut_ratio(adj, whole, near), near, _cut_ratio(adj, whole, trimmed), trimmed)
            a, near, b, trimmed = rated[v]
            if a < best1[0]:
                best1 = (a, near)
            if b < best2[0]:
                best2 = (b, trimmed)
        taken = best1[1] if best1[0] < best2[0] else best2[1]
        if not taken:
            taken = whole
        found += parts(adj, taken)
        stale = taken
        for _ in range(3):
            for i in bits(stale):
                stale |= adj[i] & whole
        for i in bits(stale):
            rated.pop(i, None)
        todo += parts(adj, whole & ~taken)
    return found


def min_cut(weight: np.ndarray) -> tuple[float, list[int], list[int]]:
    """Global minimum cut of a connected graph given as a weight matrix, NaN where there is no edge: (value, side merged last, others)."""
    w = np.where(np.isnan(weight), 0.0, weight)
    np.fill_diagonal(w, 0.0)
    alive = list(range(len(w)))
    merged = [[i] for i in alive]
    best, side = float("inf"), []
    while len(alive) > 1:
        left = np.zeros(len(w))
        waiting = list(alive)
        order = [waiting.pop(0)]
        left += w[order[0]]
        while waiting:
            k = int(np.argmax(left[waiting]))
            order.append(waiting.pop(k))
            left += w[order[-1]]
        s, t = order[-2], order[-1]
        value = float(w[t, alive].sum())
        if value < best:
            best, side = value, list(merged[t])
        w[s] += w[t]
        w[:, s] += w[:, t]
        w[s, s] = 0.0
        merged[s] += merged[t]
        alive.remove(t)
    return best, sorted(side), sorted(set(range(len(weight))) - set(side))


def complement_partition(adj: list[int], anti_weight: np.ndarray, published: bool = False) -> list[int]:
    """Node sets of one connected graph with more than three nodes, from minimum cuts of its weighted complement (NaN: no pair).

    A cut that frees one node emits that node's non-neighbours in the complement; else the better of the two sets left when the border of
    one side goes. published=True takes a node of the larger side where the freed node is on the other one, as first printed.
    """
    n = len(adj)
    full = (1 << n) - 1
    anti = [full & ~adj[i] & ~(1 << i) for i in range(n)]
    if not any(anti):
        return [full]
    left, out = full, []

    def share(part: int) -> float:
        inner = sum((adj[i] & part).bit_count() for i in bits(part))
        outer = sum(adj[i].bit_count() for i in bits(part)) - inner
        return inner / 2 / outer if outer else float("inf")

    while left:
        if left.bit_count() <= 3 or reach(anti, left, left & -left) != left:
            out.append(left)
            break
        ids = list(bits(left))
        _, last, rest = min_cut(anti_weight[np.ix_(ids, ids)])
        last, rest = [ids[i] for i in last], [ids[i] for i in rest]
        if len(last) == 1 or len(rest) == 1:
            one = last[0] if len(last) == 1 or published else rest[0]
            taken = left & ~anti[one]
        else:
            a, b = (sum(1 << i for i in side) for side in (last, rest))
            border_b = sum(1 << i for i in rest if anti[i] & a)
            border_a = sum(1 << i for i in last if anti[i] & b)
            choices = [left & ~border for border, side in ((border_b, b), (border_a, a)) if border != side]
            if len(choices) == 2:
                taken = choices[0] if share(choices[0]) > share(choices[1]) else choices[1]
            elif choices:
                taken = choices[0]
            else:
                least = min(ids, key=lambda i: ((anti[i] & left).bit_count(), i))
                taken = left & ~anti[least]
        out.append(taken)
        left &= ~taken
    return [p for s in out for p in parts(adj, s)]


def cohesive_sets(n: int, edges: list[tuple[int, int, float]], penalty: float = 2.0, least_size: int = 3, density: float = 0.3, overlap: float = 0.8) -> list[frozenset[int]]:
    """Greedy growth of sets by cohesiveness, weight inside over weight inside, across and a penalty per node, from the strongest unused
    node on; sets that overlap (shared squared over product of sizes) are joined; small and sparse ones dropped."""
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[b][a] = w
    total = [sum(x.values()) for x in near]
    used, found = set(), []
    for seed in sorted(range(n), key=lambda i: (-len(near[i]), i)):
        if seed in used or not near[seed]:
            continue
        own = {seed}
        link = dict(near[seed])  # weight of each touching node to the set
        inside, ends = 0.0, total[seed]
        rate = lambda i, e, k: i / (e - i + penalty * k)  # noqa: E731  ends counts inner weight twice, border once
        now = rate(inside, ends, 1)
        while True:
            best = (now, 0, -1)
            for x in sorted(link):
                if x not in own:
                    best = max(best, (rate(inside + link[x], ends + total[x], len(own) + 1), 1, -x), key=lambda t: t[0])
            if len(own) > 1:
                for x in sorted(own):
                    best = max(best, (rate(inside - link.get(x, 0.0), ends - total[x], len(own) - 1), 2, -x), key=lambda t: t[0])
            if best[1] == 0 or best[0] <= now + 1e-12:
                break
            now, x = best[0], -best[2]
            sign = 1 if best[1] == 1 else -1
            inside += sign * link.get(x, 0.0)
            ends += sign * total[x]
            own ^= {x}
            for y, w in near[x].items():
                link[y] = link.get(y, 0.0) + sign * w
        used |= own | {seed}
        found.append(own)
    up = list(range(len(found)))

    def find(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    holders: dict[int, list[int]] = {}
    for i, s in enumerate(found):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in enumerate(found):
        for j in {j for x in s for j in holders[x] if j < i}:
            both = len(s & found[j])
            if both * both / (len(s) * len(found[j])) >= overlap:
                up[find(i)] = find(j)
    joined: dict[int, set[int]] = {}
    for i, s in enumerate(found):
        joined.setdefault(find(i), set()).update(s)
    out = []
    for s in joined.values():
        inside = sum(w for x in s for y, w in near[x].items() if y in s and y > x)
        if len(s) >= least_size and 2 * inside / (len(s) * (len(s) - 1)) >= density:
            out.append(frozenset(s))
    return sorted(set(out), key=lambda s: (-len(s), sorted(s)))


def best_assignment(weight: np.ndarray) -> tuple[float, list[tuple[int, int]]]:
    """Matching of rows and columns of greatest total weight (all weights >= 0, 0 is no edge): shortest augmenting paths with potentials."""
    flip = weight.shape[0] > weight.shape[1]
    cost = -(weight.T if flip else weight)
    n, m = cost.shape
    row_price, col_price = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)  # row of each column, from 1; column 0 is the free end
    for i in range(1, n + 1):
        owner[0], at = i, 0
        slack, back, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while owner[at]:
            done[at] = True
            row = owner[at]
            open_cols = ~done
            open_cols[0] = False
            reduced = np.full(m + 1, np.inf)
            reduced[1:] = cost[row - 1] - row_price[row] - col_price[1:]
            better = open_cols & (reduced < slack)
            slack[better], back[better] = reduced[better], at
            nxt = int(np.argmin(np.where(open_cols, slack, np.inf)))
            step = slack[nxt]
            row_price[owner[done]] += step
            col_price[done] -= step
            slack[open_cols] -= step
            at = nxt
        while at:
            owner[at] = owner[back[at]]
            at = back[at]
    pairs = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    pairs = [(j, i) if flip else (i, j) for i, j in pairs]
    pairs = sorted((i, j) for i, j in pairs if weight[i, j] > 0)
    return float(sum(weight[i, j] for i, j in pairs)), pairs


def _entropy(counts: np.ndarray) -> np.ndarray:
    total = counts.sum(axis=-1, keepdims=True)
    p = np.divide(counts, total, out=np.zeros_like(counts), where=total > 0)
    return -(p * np.log2(np.where(p > 0, p, 1.0))).sum(axis=-1)


def mdl_cuts(value: np.ndarray, cls: np.ndarray, n: np.ndarray, alpha: float = 1.0, recursive: bool = True) -> list[float]:
    """Cuts between distinct values that lower the class entropy by more than their description costs; rows are a histogram."""
    values, at = np.unique(value, return_inverse=True)
    classes, c = np.unique(cls, return_inverse=True)
    table = np.zeros((len(values), len(classes)))
    np.add.at(table, (at, c), n)

    def split(lo: int, hi: int) -> list[float]:
        part = table[lo:hi]
        if len(part) < 2:
            return []
        whole = part.sum(axis=0)
        total = whole.sum()
        left = part.cumsum(axis=0)[:-1]
        right = whole - left
        single = (part > 0).sum(axis=1) == 1
        same = single[:-1] & single[1:] & (part[:-1].argmax(axis=1) == part[1:].argmax(axis=1))
        e1, e2, e = _entropy(left), _entropy(right), float(_entropy(whole[None])[0])
        weighed = (left.sum(axis=1) * e1 + right.sum(axis=1) * e2) / total
        weighed[same] = np.inf
        if not np.isfinite(weighed).any():
            return []
        i = int(weighed.argmin())
        k, k1, k2 = (int((x > 0).sum()) for x in (whole, left[i], right[i]))
        delta = log2(max(3**k - 2, 1)) - (k * e - k1 * e1[i] - k2 * e2[i])
        if e - weighed[i] <= alpha * ((log2(total - 1) if total > 1 else 0.0) / total + delta / total):
            return []
        middle = [float(values[lo + i] + values[lo + i + 1]) / 2]
        return split(lo, lo + i + 1) + middle + split(lo + i + 1, hi) if recursive else middle

    return split(0, len(values))


def pool_ratios(one: np.ndarray, zero: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring bins pooled (sums shared evenly) until one / zero does not fall along them."""
    pools: list[list[float]] = []
    for a, b in zip(one, zero, strict=True):
        pools.append([float(a), float(b), 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] > pools[-1][0] * pools[-2][1]:
            top = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], top, strict=True)]
    a = np.concatenate([np.full(int(k), x / k) for x, _, k in pools])
    b = np.concatenate([np.full(int(k), y / k) for _, y, k in pools])
    return a, b
