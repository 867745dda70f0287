"""Plain definitions of the network methods on small networks: sets of names and loops over them, nothing kept from step to step."""

import itertools
from math import log2, sqrt

import numpy as np


def network(rows):
    """rows (u, v, w) -> neighbours with weights."""
    near = {}
    for u, v, w in rows:
        near.setdefault(u, {})[v] = w
        near.setdefault(v, {})[u] = w
    return near


def pieces(near, inside, linked=lambda near, a, b: b in near[a]):
    """Connected pieces of the nodes inside, each sorted, in order of their first node."""
    left, out = sorted(inside), []
    while left:
        piece = {left[0]}
        while True:
            more = {b for b in left if b not in piece and any(linked(near, a, b) for a in piece)}
            if not more:
                break
            piece |= more
        out.append(frozenset(piece))
        left = [x for x in left if x not in piece]
    return out


def apart(near, a, b):
    return a != b and b not in near[a]


def ratio(near, whole, part):
    inner = sum(y in part for x in part for y in near[x])
    outer = sum(y in whole for x in part for y in near[x])
    if not inner:
        return 100.0
    n = len(part)
    return (outer / inner + (outer / inner - 1) / (inner / (n * (n - 1)))) / 2


def trimmed(near, whole, ball):
    """The ball without the nodes that make its complement fall apart."""
    one = lambda inside: len(pieces(near, inside, apart)) <= 1
    if not one(ball):
        return ball
    choices = [{x} for x in sorted(ball) if len(pieces(near, ball - {x}, apart)) > 1]
    if not choices:
        others = {x: {y for y in ball if apart(near, x, y)} for x in ball}
        least = min(map(len, others.values()))
        top = set(sorted(ball, key=lambda x: (-len(others[x]), x))[:least])
        if len(top) == len(ball) - 1 or not one(ball - top):
            choices.append(top)
        choices += [others[x] for x in sorted(ball) if len(others[x]) == least]
    return ball - min(choices, key=lambda c: (ratio(near, whole, ball - c), sorted(c)))


def coherent(near, whole):
    whole = frozenset(whole)
    if len(whole) <= 3:
        return pieces(near, whole)
    one, two = (float("inf"), frozenset()), (float("inf"), frozenset())
    for x in sorted(whole):
        ball1 = (frozenset(near[x]) | {x}) & whole
        ball2 = frozenset(y for z in ball1 for y in [z, *near[z]]) & whole
        cut = frozenset(trimmed(near, whole, ball2))
        one = min(one, (ratio(near, whole, ball1), ball1), key=lambda t: t[0])
        two = min(two, (ratio(near, whole, cut), cut), key=lambda t: t[0])
    taken = (one[1] if one[0] < two[0] else two[1]) or whole
    return pieces(near, taken) + [s for p in pieces(near, whole - taken) for s in coherent(near, p)]


def paths(near):
    """Weights of three-edge paths between nodes without an edge."""
    out = {}
    for u in near:
        for a in near[u]:
            for b in near[a]:
                for v in near[b]:
                    if len({u, a, b, v}) == 4 and v not in near[u]:
                        out[u, v] = out.get((u, v), 0.0) + 1 / sqrt(len(near[a]) * len(near[b]))
    return out


def complement(near, whole, min_cut):
    """Minimum cuts (found by min_cut on a matrix) of the complement, weighed by paths."""
    names, weight = sorted(whole), paths(near)
    if len(names) <= 3 or not any(apart(near, a, b) for a in names for b in names):
        return [frozenset(names)]
    left, out = set(names), []
    share = lambda part: (lambda i, o: i / 2 / o if o else float("inf"))(sum(y in part for x in part for y in near[x]), sum(y not in part for x in part for y in near[x]))
    while left:
        if len(left) <= 3 or len(pieces(near, left, apart)) > 1:
            out.append(left)
            break
        ids = sorted(left)
        matrix = np.array([[weight.get((a, b), 0.0) if apart(near, a, b) else np.nan for b in ids] for a in ids])
        _, last, rest = min_cut(matrix)
        last, rest = {ids[i] for i in last}, {ids[i] for i in rest}
        if 1 in (len(last), len(rest)):
            one = min(last) if len(last) == 1 else min(rest)
            taken = {x for x in left if not apart(near, one, x)}
        else:
            border = lambda side, other: {x for x in side if any(apart(near, x, y) for y in other)}
            choices = [left - border(side, other) for side, other in ((rest, last), (last, rest)) if border(side, other) != side]
            if len(choices) == 2:
                taken = choices[0] if share(choices[0]) > share(choices[1]) else choices[1]
            elif choices:
                taken = choices[0]
            else:
                fewest = min(ids, key=lambda x: (sum(apart(near, x, y) for y in left), x))
                taken = {x for x in left if not apart(near, fewest, x)}
        out.append(taken)
        left = left - taken
    return [p for s in out for p in pieces(near, s)]


def cohesive(near, whole, least_size=3, density=0.3, penalty=2.0, overlap=0.8):
    def rate(s):
        inside = sum(w for x in s for y, w in near[x].items() if y in s) / 2
        return inside / (inside + sum(w for x in s for y, w in near[x].items() if y not in s) + penalty * len(s))

    used, found = set(), []
    for seed in sorted(whole, key=lambda x: (-len(near[x]), x)):
        if seed in used:
            continue
        own = frozenset({seed})
        while True:
            options = [own | {x} for x in sorted({y for z in own for y in near[z]} - own)]
            options += [own - {x} for x in sorted(own)] if len(own) > 1 else []
            best = max(options, key=rate)
            if rate(best) <= rate(own) + 1e-12:
                break
            own = best
        used |= own | {seed}
        found.append(own)
    groups = [{i} for i in range(len(found))]
    for i, j in itertools.combinations(range(len(found)), 2):
        if len(found[i] & found[j]) ** 2 >= overlap * len(found[i]) * len(found[j]):
            a, b = (next(g for g in groups if k in g) for k in (i, j))
            if a is not b:
                groups.remove(b)
                a |= b
    joined = {frozenset().union(*(found[i] for i in g)) for g in groups}
    dense = lambda s: sum(w for x in s for y, w in near[x].items() if y in s) / (len(s) * (len(s) - 1))
    return [s for s in joined if len(s) >= least_size and dense(s) >= density]


def cliques(near, whole):
    full = [frozenset(c) for k in range(1, len(whole) + 1) for c in itertools.combinations(sorted(whole), k) if all(b in near[a] for a, b in itertools.combinations(c, 2))]
    return [c for c in full if not any(c < d for d in full)]


def merged_cliques(near, whole, least=4, overlap=0.5, merge=0.75):
    density = lambda s: sum(near[a].get(b, 0) for a in s for b in s if a != b) / (len(s) * (len(s) - 1))
    between = lambda a, b: sum(near[x].get(y, 0) for x in a - b for y in b) / (len(a - b) * len(b)) if a - b else 1.0
    todo = sorted((c for c in cliques(near, whole) if len(c) >= least), key=lambda c: (-density(c), sorted(c)))
    out = []
    while todo:
        first, later = todo[0], []
        for c in todo[1:]:
            if len(first & c) < overlap * len(c):
                later.append(c)
            elif sqrt(between(first, c) * between(c, first)) >= merge:
                first |= c
        out.append(first)
        todo = later
    return out


def steps_within(near, s, steps):
    for x in s:
        ball = {x}
        for _ in range(steps):
            ball |= {y for z in ball for y in near[z] if y in s}
        if ball != set(s):
            return False
    return True


def dense_growth(near, whole, least=4, steps=2, share=0.6):
    tie = lambda a, b: len(near[a].keys() & near[b].keys())
    free, out = set(whole), set()
    for seed in sorted(whole, key=lambda x: (-sum(tie(x, y) for y in near[x]), -len(near[x]), x)):
        if seed not in free:
            continue
        own = {seed}
        while True:
            around = {y for x in own for y in near[x]} - own
            links = {x: [y for y in near[x] if y in own] for x in around}
            ready = sorted((x for x in around if len(links[x]) >= share * len(own)), key=lambda x: (-sum(tie(x, y) for y in links[x]), -len(links[x]), x))
            step = next((x for x in ready if steps_within(near, own | {x}, steps)), None)
            if step is None:
                break
            own.add(step)
        free -= own
        if len(own) >= least:
            out.add(frozenset(own))
    return list(out)


def entropy(counts):
    total = sum(counts)
    return -sum(c / total * log2(c / total) for c in counts if c)


def mdl_cuts(rows, alpha=1.0, recursive=True):
    """rows (value, class): cuts that pay for their description, by trying all."""
    values = sorted({v for v, _ in rows})
    classes = sorted({c for _, c in rows})
    count = lambda part: [sum(c == k for _, c in part) for k in classes]
    best = None
    for low, high in zip(values, values[1:], strict=False):
        at_low, at_high = ({c for v, c in rows if v == x} for x in (low, high))
        if len(at_low) == 1 and at_low == at_high:
            continue
        left, right = [r for r in rows if r[0] <= low], [r for r in rows if r[0] > low]
        e = (len(left) * entropy(count(left)) + len(right) * entropy(count(right))) / len(rows)
        if best is None or e < best[0] - 1e-12:
            best = (e, (low + high) / 2, left, right)
    if best is None:
        return []
    e, cut, left, right = best
    k, k1, k2 = (len({c for _, c in part}) for part in (rows, left, right))
    delta = log2(max(3**k - 2, 1)) - (k * entropy(count(rows)) - k1 * entropy(count(left)) - k2 * entropy(count(right)))
    if entropy(count(rows)) - e <= alpha * (log2(len(rows) - 1) + delta) / len(rows):
        return []
    return mdl_cuts(left, alpha) + [cut] + mdl_cuts(right, alpha) if recursive else [cut]


def disjoint_paths(near, s, t):
    """By the smallest set of other nodes that separates them; an edge between them is one path more."""
    direct = t in near[s]
    near = {x: {y for y in near[x] if {x, y} != {s, t}} for x in near}
    others = [x for x in near if x not in (s, t)]
    for k in range(len(others) + 1):
        for gone in itertools.combinations(others, k):
            left = set(near) - set(gone)
            seen = {s}
            while more := {y for x in seen for y in near[x] if y in left} - seen:
                seen |= more
            if t not in seen:
                return k + direct
    raise AssertionError


def heaviest(rows):
    """Total weight of the best matching, over all subsets of nodes."""
    names = sorted({x for u, v, _ in rows for x in (u, v)})
    at = {x: i for i, x in enumerate(names)}
    weight = {(max(at[u], at[v]), min(at[u], at[v])): w for u, v, w in rows}
    best = [0.0] * (1 << len(names))
    for mask in range(1, 1 << len(names)):
        i = mask.bit_length() - 1
        rest = mask & ~(1 << i)
        best[mask] = max([best[rest]] + [best[rest & ~(1 << j)] + weight[i, j] for j in range(i) if rest >> j & 1 and (i, j) in weight])
    return best[-1]
