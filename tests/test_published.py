import itertools
import random

import pytest

from netsets.operators import kernels as K
from netsets.operators import published as B


def masks(adj):
    return [m for m in range(1, 1 << len(adj)) if all(m & ~(1 << i) & ~adj[i] == 0 for i in K.bits(m))]


@pytest.mark.parametrize("seed", range(20))
def test_maximal_cliques(seed):
    rng = random.Random(seed)
    n = 9
    adj = [0] * n
    for i, j in itertools.combinations(range(n), 2):
        if rng.random() < 0.5:
            adj[i] |= 1 << j
            adj[j] |= 1 << i
    cliques = masks(adj)
    want = sorted(m for m in cliques if not any(m != k and m & k == m for k in cliques))
    assert sorted(B.maximal_cliques(adj)) == want
    for s in B.dense_growth(adj) + B.cores_and_attachments(adj):
        assert K.reach(adj, s, s & -s) == s


def two_cliques(shared):
    """Two cliques of five nodes that share some; names a..e and the last `shared` of them with others."""
    left = "abcde"
    right = left[5 - shared :] + "vwxyz"[: 5 - shared]
    return K.graph([(x, y) for side in (left, right) for x, y in itertools.combinations(side, 2)])


def test_hand_made():
    names, adj = two_cliques(1)
    shown = lambda sets: sorted("".join(names[i] for i in K.bits(s)) for s in sets)
    weight = {(i, j): 1.0 for i in range(len(adj)) for j in K.bits(adj[i])}
    assert shown(B.merged_cliques(adj, weight)) == ["abcde", "evwxy"]
    assert shown(B.dense_growth(adj))[0].startswith("abcd") and len(B.dense_growth(adj)) == 2
    assert all(len(s) >= 5 for s in shown(B.cores_and_attachments(adj)))
    names, adj = two_cliques(4)
    weight = {(i, j): 1.0 for i in range(len(adj)) for j in K.bits(adj[i])}
    assert shown(B.merged_cliques(adj, weight)) == ["abcdev"]  # well connected: joined
    assert B.merged_cliques(adj, weight, merge=1.0) == [min(B.maximal_cliques(adj), key=lambda c: sorted(K.bits(c)))]
