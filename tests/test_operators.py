import random

import pytest
from pyspark.sql import functions as F

from netsets.operators import clusters as C
from netsets.operators import filters as FL
from netsets.operators import graph as G
from netsets.operators import metrics as M
from netsets.operators import ontology as O
from netsets.operators import partition as P
from netsets.operators import weights as W


def edges_of(spark, rows):
    return spark.createDataFrame([(min(u, v), max(u, v), float(w)) for u, v, w in rows], "u string, v string, w double")


def sets_of(spark, sets):
    return spark.createDataFrame([(c, n) for c, m in sets.items() for n in m], "cid string, node string")


def random_edges(rng, n=25, p=0.2):
    return [(f"n{i:02d}", f"n{j:02d}", rng.randrange(1, 10) / 10) for i in range(n) for j in range(i + 1, n) if rng.random() < p]


def test_canonical_last_wins(spark):
    rows = spark.createDataFrame([("b", "a", 1.0, 1), ("a", "b", 2.0, 2), ("a", "a", 9.0, 3), ("c", "a", 3.0, 4)], "u string, v string, w double, at int")
    assert {tuple(r) for r in G.canonical(rows, order="at").collect()} == {("a", "b", 2.0), ("a", "c", 3.0)}


@pytest.mark.parametrize("finish", [0, 200_000])
def test_components_of_a_long_path(spark, monkeypatch, finish):
    monkeypatch.setattr(G, "FINISH_LINKS", finish)
    rows = [(f"{i:03d}", f"{i + 1:03d}", 1) for i in range(60)] + [("x1", "x2", 1)]
    random.Random(0).shuffle(rows)
    got = {r.node: r.component for r in G.components(edges_of(spark, rows), spark.createDataFrame([("alone",)], "node string")).collect()}
    assert all(got[f"{i:03d}"] == "000" for i in range(61)) and got["x2"] == "x1" and got["alone"] == "alone"


def test_triangles_and_clustering(spark):
    rows = random_edges(random.Random(1))
    near = {}
    for u, v, _ in rows:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    want = {(a, b, c) for a in near for b in near[a] for c in near[a] & near[b] if a < b < c}
    weight = {(u, v): w for u, v, w in rows}
    got = G.triangles(edges_of(spark, rows)).collect()
    assert {(r.a, r.b, r.c) for r in got} == want and len(got) == len(want)
    assert all((r.wab, r.wac, r.wbc) == (weight[r.a, r.b], weight[r.a, r.c], weight[r.b, r.c]) for r in got)
    star = edges_of(spark, [("c", x, 1) for x in "defg"])
    assert {r.coefficient for r in G.clustering(star).collect()} == {0.0} and G.diameter(star) == 2


def test_adjust_cd_against_loops(spark):
    rows = random_edges(random.Random(2))
    near = {}
    for u, v, _ in rows:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    mean = sum(map(len, near.values())) / len(near)
    pad = {x: max(0.0, mean - len(near[x])) for x in near}
    one = lambda x, y: 2 * len(near[x] & near[y]) / (len(near[x]) + pad[x] + len(near[y]) + pad[y])
    s = {x: sum(one(y, x) for y in near[x]) for x in near}
    for r in W.adjust_cd(edges_of(spark, rows)).collect():
        den = s[r.u] + pad[r.u] + s[r.v] + pad[r.v]
        want = sum(one(x, r.u) + one(x, r.v) for x in near[r.u] & near[r.v]) / den if den > 0 else 0
        assert r.w == pytest.approx(want)


def greedy(order, match):
    kept = []
    for x in order:
        if not any(match(x, k) for k in kept):
            kept.append(x)
    return set(kept)


def random_sets(rng, n=40):
    return {f"s{i:02d}": set(rng.choices("abcdefghijkl", k=rng.randrange(1, 8))) for i in range(n)}


def aware(a, b):
    if len(a) <= 3 and len(b) <= 3:
        return float(a == b)
    return 0.0 if len(a) <= 3 or len(b) <= 3 else len(a & b) / len(a | b)


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_dedup_and_combine(spark, seed):
    rng = random.Random(seed)
    sets = random_sets(rng)
    score = {c: rng.randrange(20) / 10 for c in sets}
    src = {c: rng.choice("xyz") for c in sets}
    scored = spark.createDataFrame([(c, src[c], score[c]) for c in sets], "cid string, src string, score double")
    match = lambda a, b: aware(sets[a], sets[b]) >= 0.5
    for by_score in (False, True):
        order = sorted(sets, key=lambda c: (-score[c], c)) if by_score else sorted(sets)
        assert {r.cid for r in C.dedup(scored, sets_of(spark, sets), 0.5, by_score).collect()} == greedy(order, match)
    assert combined(scored, sets, 3) == expected_groups(sets, src, score, 3, 0)


def combined(scored, sets, n, **options):
    spark = scored.sparkSession
    return {r.cid: (round(r.score, 9), r.sources) for r in C.combine(scored, sets_of(spark, sets), n, 0.5, **options).collect()}


def expected_groups(sets, src, score, n, over):
    """One pass inside each source, one over what is left; plain similarity, and no match for sets of at most `over` members."""
    plain = lambda a, b: min(len(sets[a]), len(sets[b])) > over and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5
    order = sorted(src, key=lambda c: (-score[c], c))
    order = [c for c in order if c in greedy(order, lambda a, b: src[a] == src[b] and plain(a, b))]
    kept, groups = [], {}
    for c in order:
        rep = next((k for k in kept if plain(c, k)), None)
        if rep is None:
            kept.append(c)
        g = groups.setdefault(rep or c, {})
        g[src[c]] = max(g.get(src[c], -1), score[c])
    return {k: (round(sum(g.values()) / n, 9), ",".join(sorted(g))) for k, g in groups.items()}


@pytest.mark.parametrize("small", [None, "y"])
def test_integrate_against_loops(spark, small):
    rng = random.Random(7)
    sets = random_sets(rng, 60)
    src = {c: rng.choice("xyz") for c in sets}
    score = {c: rng.choice([0.0, 0.00005, 0.00015, 0.3, 0.6, 0.9]) + rng.randrange(5) / 1000 * (rng.random() < 0.7) for c in sets}
    factors = {"x": 1.0, "y": 0.5}
    scored = spark.createDataFrame([(c, src[c], score[c]) for c in sets], "cid string, src string, score double")
    kept = [c for c in sets if score[c] >= 1e-4 and (len(sets[c]) >= 4 or src[c] == small)]  # the floor is on the score as it came
    weighed = {c: score[c] * factors.get(src[c], 1.0) for c in kept}
    got = {r.cid: (round(r.score, 9), r.sources) for r in C.integrate(scored, sets_of(spark, sets), factors, 0.5, small_from=small).collect()}
    assert got == expected_groups(sets, {c: src[c] for c in kept}, weighed, 1, 3)
    assert (small is None) == all(len(sets[c]) >= 4 for c in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_readd_scored_against_loops(spark, seed):
    rng = random.Random(seed)
    rows, topo = random_edges(rng, 18, 0.5), random_edges(rng, 18, 0.5)
    w, t = ({frozenset(x[:2]): x[2] for x in r} for r in (rows, topo))
    names = sorted({x for r in (rows, topo) for u, v, _ in r for x in (u, v)})
    hubs, rest = names[:6], names[6:]
    sets = {f"c{i}": set(rng.sample(rest, rng.randrange(2, 5))) | set(rng.sample(hubs, i % 2)) for i in range(6)}
    score = {c: rng.randrange(1, 10) / 10 for c in sets}
    want = {}
    for c, first in sets.items():
        mean = lambda x, weight: sum(weight.get(frozenset((x, y)), 0) for y in first if frozenset((x, y)) in w) / len(first)  # noqa: E731, B023
        now, s = set(first), score[c]
        for h in sorted((h for h in hubs if h not in first), key=lambda h: (-mean(h, w), h)):
            if mean(h, t) >= 0.25:
                n = len(now)
                s = (s * n * (n - 1) / 2 + mean(h, w) * n) / (n * (n + 1) / 2)
                now.add(h)
        want[c] = (frozenset(now), round(s, 9))
    scored = spark.createDataFrame(list(score.items()), "cid string, score double")
    back, rescored = C.readd_scored(scored, sets_of(spark, sets), spark.createDataFrame([(h,) for h in hubs], "node string"), edges_of(spark, rows), edges_of(spark, topo), 0.25)
    got = {r.cid: [set(), round(r.score, 9)] for r in rescored.collect()}
    for r in back.collect():
        got[r.cid][0].add(r.node)
    assert {c: (frozenset(m), s) for c, (m, s) in got.items()} == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hub_return_against_loops(spark, seed):
    rng = random.Random(seed)
    rows = random_edges(rng, 20, 0.4)
    w = {frozenset(x[:2]): x[2] for x in rows}
    degree = {}
    for u, v, _ in rows:
        degree[u] = degree.get(u, 0) + 1
        degree[v] = degree.get(v, 0) + 1
    hubs = sorted(degree, key=lambda x: (-degree[x], x))[:8]
    rest = [x for x in degree if x not in hubs]
    sets = {f"c{i}": set(rng.sample(rest, rng.randrange(1, 4))) for i in range(6)}
    want = {}
    for c, m in sets.items():
        m = set(m)
        for h in hubs:
            if h not in m and sum(w.get(frozenset((h, x)), 0) for x in m) / len(m) > 0.2:
                m.add(h)
        inner = sum(v for k, v in w.items() if k <= m)
        if len(m) >= 2 and inner > 0:
            want[c] = (frozenset(m), round(4 * inner / (len(m) * (len(m) - 1)), 9))
    net = edges_of(spark, rows)
    got = {}
    for r in C.return_hubs(sets_of(spark, sets), spark.createDataFrame([(h, degree[h]) for h in hubs], "node string, degree long"), net, net, 0.2).collect():
        got.setdefault(r.cid, [set(), round(r.score, 9)])[0].add(r.node)
    assert {c: (frozenset(m), s) for c, (m, s) in got.items()} == want


def test_curve_against_a_loop(spark):
    rng = random.Random(4)
    preds, refs = random_sets(rng, 60), random_sets(rng, 30)
    score = {c: rng.randrange(15) / 10 for c in preds}
    scored = spark.createDataFrame(list(score.items()), "cid string, score double")
    gate, points, found, good, n = 0.01, [], set(), 0, 0
    levels = sorted(set(score.values()), reverse=True)
    for s in levels:
        for c in (c for c in preds if score[c] == s):
            hits = {r for r in refs if aware(preds[c], refs[r]) >= 0.5}
            n, good, found = n + 1, good + bool(hits), found | hits
        recall = len(found) / len(refs)
        if recall >= gate or s == levels[-1]:
            points.append((s, n, round(good / n, 9), round(recall, 9)))
            while gate <= recall:
                gate += 0.01
    got = [(r.threshold, r.n_preds, round(r.precision, 9), round(r.recall, 9)) for r in M.pr_curve(scored, sets_of(spark, preds), sets_of(spark, refs)).orderBy(F.desc("threshold")).collect()]
    assert got == points
    area, before = 0.0, 0.0
    for _, _, p, r in points:
        area, before = area + (r - before) * p, r
    assert M.auc_pr(scored, sets_of(spark, preds), sets_of(spark, refs)).first().auc == pytest.approx(area, abs=1e-6)


def test_limits_and_empty(spark):
    rows = random_edges(random.Random(5))
    used, kept = {}, set()
    for u, v, w in sorted(rows, key=lambda r: (-r[2], r[0], r[1]))[:40]:
        if used.get(u, 0) < 3 and used.get(v, 0) < 3:
            kept.add((u, v, w))
            used[u], used[v] = used.get(u, 0) + 1, used.get(v, 0) + 1
    assert {tuple(r) for r in FL.limit_degree(edges_of(spark, rows), 40, 3).collect()} == kept
    none = edges_of(spark, [])
    for f in (G.components, G.triangles, G.clustering, W.adjust_cd, W.p3_complement, P.coherent_partition, P.complement_partition, P.cohesive_sets):
        assert f(none).count() == 0
    assert M.precision_recall(sets_of(spark, {}), sets_of(spark, {"a": {"x"}})).first().recall == 0.0


def test_hub_threshold(spark):
    rows = [("h1", f"l{i}", 1) for i in range(4)] + [("h2", f"m{i}", 1) for i in range(3)] + [("h1", "c", 1), ("h2", "c", 1)]
    assert tuple(P.hub_threshold(edges_of(spark, rows)).first()) == (3, 2)
    assert {r.node for r in P.hubs(edges_of(spark, rows)).collect()} == {"h1", "h2", "c"}
    # no jump: every node is a hub
    assert P.hubs(edges_of(spark, [("a", "b", 1), ("b", "c", 1)])).count() == 3


def test_ontology(spark):
    links = spark.createDataFrame([("a", "r"), ("b", "r"), ("c", "a"), ("d", "a"), ("d", "b")], "child string, parent string")
    assert {tuple(r) for r in O.closure(links).collect()} == {("a", "r"), ("b", "r"), ("c", "a"), ("d", "a"), ("d", "b"), ("c", "r"), ("d", "r")}
    direct = spark.createDataFrame([("n1", "c"), ("n2", "c"), ("n3", "d"), ("n4", "b"), ("n5", "a")], "node string, term string")
    annots = O.propagate(direct, links)
    assert {r.term: r.n for r in O.term_counts(annots).collect()} == {"r": 5, "a": 4, "b": 2, "c": 2, "d": 1}
    assert {r.term for r in O.informative_terms(annots, links, 2).collect()} == {"c", "b"}
    filled = O.informative_terms(annots, links, 4, floor=2, fill=True)
    assert {r.term for r in filled.collect()} == {"a", "b"}
    terms = spark.createDataFrame([("c",), ("b",)], "term string")
    bad = O.incompatible_edges(edges_of(spark, [("n1", "n2", 1), ("n1", "n4", 1), ("n1", "n5", 1)]), annots, links, terms)
    assert {(r.u, r.v): r.p for r in bad.collect()} == {("n1", "n4"): 0.0, ("n1", "n5"): 0.5}


def test_diameter_beyond_the_steps_of_the_sql(spark):
    path = edges_of(spark, [(f"{i:03d}", f"{i + 1:03d}", 1) for i in range(34)]).coalesce(1)
    assert G.diameter(path) == 34


def test_set_pairs_once_for_any_chunks(spark, monkeypatch):
    monkeypatch.setattr(FL, "CHUNK_NODES", 3)
    sets = {"a": [f"n{i}" for i in range(11)], "b": [f"n{i}" for i in range(7, 20)], "c": ["n0", "n10", "n12", "n12"], "one": ["x"]}
    want = sorted({(u, v) for m in sets.values() for u in m for v in m if u < v})
    rows = sets_of(spark, sets).unionByName(spark.createDataFrame([("a", None), (None, "n1"), (None, "n30")], "cid string, node string"))
    assert sorted((r.u, r.v) for r in FL.set_pairs(rows).collect()) == want


def test_pairs_of_nodes_of_one_set_are_not_sent(spark):
    """The only exchange after pairs are made is that of nodes in several sets."""
    got = FL.set_pairs(sets_of(spark, {"a": ["x", "y", "z"], "b": ["v", "w"]}))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    free = plan[: plan.index("Aggregate")]
    assert free.count("Generate explode") == 2 and "several" in free
