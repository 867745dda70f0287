import itertools
import random

import numpy as np
import pytest

from netsets.operators import kernels as K


def random_graph(rng, n, p):
    return K.graph([(f"n{i:02d}", f"n{j:02d}") for i in range(n) for j in range(i) if rng.random() < p] + [(f"n{i:02d}", f"n{i:02d}") for i in range(n)])


@pytest.mark.parametrize("seed", range(30))
def test_articulation_points(seed):
    rng = random.Random(seed)
    _, adj = random_graph(rng, 9, 0.25)
    full = (1 << len(adj)) - 1
    want = [v for v in range(len(adj)) if len(K.parts(adj, full & ~(1 << v))) > len(K.parts(adj, full)) - (adj[v] == 0)]
    assert K.articulation_points(adj, full) == want


@pytest.mark.parametrize("seed", range(20))
def test_min_cut(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 8))
    w = rng.integers(0, 9, (n, n)).astype(float)
    w = np.triu(w, 1) + np.triu(w, 1).T
    value, a, b = K.min_cut(w)
    assert sorted(a + b) == list(range(n)) and w[np.ix_(a, b)].sum() == value
    sides = [s for k in range(1, n) for s in itertools.combinations(range(n), k)]
    assert value == min(w[np.ix_(s, [x for x in range(n) if x not in s])].sum() for s in sides)


@pytest.mark.parametrize("seed", range(30))
def test_best_assignment(seed):
    rng = np.random.default_rng(seed)
    n, m = map(int, rng.integers(1, 6, 2))
    w = rng.random((n, m)) * (rng.random((n, m)) < 0.6)
    total, pairs = K.best_assignment(w)
    small, large = (w, m) if n <= m else (w.T, n)
    best = max(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(large), min(n, m)))
    assert total == pytest.approx(best)
    assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)


@pytest.mark.parametrize("seed", range(20))
def test_hub_cut(seed):
    rng = random.Random(seed)
    n = 12
    edges = [(i, j) for i in range(n) for j in range(i) if rng.random() < 0.2]
    adj = [0] * n
    for i, j in edges:
        adj[i] |= 1 << j
        adj[j] |= 1 << i
    share = [1.0] + [max(p.bit_count() for p in K.parts(adj, (1 << k) - 1)) / k for k in range(1, n + 1)]
    jumps = [(share[k] - share[k - 1], -k) for k in range(1, n + 1)]
    best = max(jumps)
    assert K.hub_cut(n, edges) == (-best[1] if best[0] > 0 else 0)


@pytest.mark.parametrize("seed", range(12))
def test_partitions_cover_all_nodes(seed):
    rng = random.Random(seed)
    names, adj = random_graph(rng, 14, 0.2)
    found = K.coherent_partition(adj)
    assert sum(found) == (1 << len(names)) - 1 and all(K.reach(adj, s, s & -s) == s for s in found)
    for part in K.parts(adj, (1 << len(adj)) - 1):
        ids = list(K.bits(part))
        if len(ids) > 3:
            sub = [sum(1 << k for k, j in enumerate(ids) if adj[i] >> j & 1) for i in ids]
            weight = np.where([[i != j and not sub[i] >> j & 1 for j in range(len(ids))] for i in range(len(ids))], np.random.default_rng(seed).random((len(ids),) * 2).round(2), np.nan)
            weight = np.fmax(weight, weight.T)
            for flag in (False, True):
                sets = K.complement_partition(sub, weight, flag)
                assert sum(sets) == (1 << len(ids)) - 1 and all(K.reach(sub, s, s & -s) == s for s in sets)


def test_coherent_ratings_are_fresh():
    """Kept ratings give what rating every node anew gives."""

    def plain(adj):
        found, todo = [], K.parts(adj, (1 << len(adj)) - 1)
        while todo:
            whole = todo.pop()
            if whole.bit_count() <= 3:
                found += K.parts(adj, whole)
                continue
            one, two = (float("inf"), 0), (float("inf"), 0)
            for v in K.bits(whole):
                near = adj[v] & whole | 1 << v
                ball = near
                for i in K.bits(near):
                    ball |= adj[i] & whole
                trimmed = K._coherent(adj, whole, ball)
                a, b = K._cut_ratio(adj, whole, near), K._cut_ratio(adj, whole, trimmed)
                one, two = min(one, (a, near), key=lambda t: t[0]), min(two, (b, trimmed), key=lambda t: t[0])
            taken = (one[1] if one[0] < two[0] else two[1]) or whole
            found += K.parts(adj, taken)
            todo += K.parts(adj, whole & ~taken)
        return found

    for seed in range(15):
        _, adj = random_graph(random.Random(seed), 24, 0.12)
        assert sorted(plain(adj)) == sorted(K.coherent_partition(adj))


def test_hand_made_graphs():
    edge = lambda *p: K.graph([tuple(x) for x in p])
    names, adj = edge("ab", "ac", "bc", "cd", "de", "df", "ef")  # two triangles joined by an edge
    assert sorted("".join(names[i] for i in K.bits(s)) for s in K.coherent_partition(adj)) == ["abc", "def"]
    names, adj = edge("ab", "ac", "ad", "bc", "bd", "cd")
    assert K.coherent_partition(adj) == [15] and K.complement_partition(adj, np.full((4, 4), np.nan)) == [15]
    two = [(0, 1, 1.0), (0, 2, 1.0), (1, 2, 1.0), (2, 3, 0.1), (3, 4, 1.0), (3, 5, 1.0), (4, 5, 1.0)]
    assert K.cohesive_sets(6, two, penalty=0.0) == [frozenset({0, 1, 2}), frozenset({3, 4, 5})]


def test_mdl_and_pooling():
    value = np.repeat(np.arange(10.0), 2)
    cls = np.tile([0, 1], 10)
    n = np.where((value < 5) == (cls == 0), 20.0, 1.0)
    assert K.mdl_cuts(value, cls, n) == [4.5]
    assert K.mdl_cuts(value, cls, np.full(20, 5.0)) == []
    assert K.mdl_cuts(np.array([1.0]), np.array([0]), np.array([3.0])) == []
    a, b = K.pool_ratios(np.array([0.1, 0.5, 0.2, 0.9]), np.array([0.4, 0.3, 0.3, 0.1]))
    assert (np.diff(a / b) >= -1e-12).all() and a.sum() == pytest.approx(1.7)
