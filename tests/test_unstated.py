"""The queries that no SQL states, against plain definitions on the smallest tables and on made networks."""

import os
import random

import pytest

from netsets.operators import clusters as C
from netsets.operators import evidence as E
from netsets.operators import filters as FL
from netsets.operators import graph as G
from netsets.operators import kernels as K
from netsets.operators import partition as P
from netsets.operators import weights as W
from netsets.plans import pipelines
from netsets.plans.lineage import cut
from netsets.plans.registry import ORACLES, QUERIES
from netsets.sources import views as V
from tests import slow
from tests.test_operators import aware, edges_of, greedy

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")

PARTITIONS = {
    "coherent_partition": (P.coherent_partition, slow.coherent),
    "complement_partition": (P.complement_partition, lambda near, whole: slow.complement(near, whole, K.min_cut)),
    "cohesive_sets": (P.cohesive_sets, slow.cohesive),
    "merged_cliques": (lambda e: P.published_sets(e, "merged_cliques", least=3), lambda near, whole: slow.merged_cliques(near, whole, 3)),
    "dense_growth": (lambda e: P.published_sets(e, "dense_growth", least=3), lambda near, whole: slow.dense_growth(near, whole, 3)),
}
UNSTATED = {*PARTITIONS, "cores_and_attachments", "heaviest_pairs", "hub_return", "node_connectivity", "mdl_cutpoints", "selected_features", "iso_em_scores", "pipeline_single", "pipeline_ensemble", "pipeline_integrated"}


def rows_of(df):
    return [(r.u, r.v, r.w) for r in df.select("u", "v", "w").collect()]


def sets_in(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.cid, set()).add(r.node)
    return out


def shown(sets):
    return sorted(map(sorted, sets))


def made(seed, n=13, p=0.28, parts=4):
    """Several components of random edges whose sums have no ties."""
    rng = random.Random(seed)
    names = [[f"{k}{i:02d}" for i in range(rng.randrange(4, n))] for k in "abcdef"[:parts]]
    return [(u, v, rng.randrange(1, 1000) / 1009) for own in names for i, u in enumerate(own) for v in own[i + 1 :] if rng.random() < p]


def test_all_queries_are_held_against_something():
    assert set(QUERIES) - set(ORACLES) <= UNSTATED


@pytest.mark.parametrize("name", sorted(PARTITIONS))
def test_partitions(spark, name):
    query, plain = PARTITIONS[name]
    kept = rows_of(V.kept(spark, SF))
    strong = [[(u, v, 4 * w) for u, v, w in made(s)] for s in (1, 2)]
    for rows, got in ((kept, QUERIES[name](spark, SF)), *((rows, query(edges_of(spark, rows))) for rows in strong)):
        near = slow.network(rows)
        want = [s for whole in slow.pieces(near, near) for s in plain(near, whole)]
        assert shown(sets_in(got).values()) == shown(want)
    assert want


def test_cores_and_attachments(spark):
    """Sets are connected; each holds a dense core, and every other member is tied to half of it; nothing tied to half of all is left out."""
    for rows, got in ((rows_of(V.kept(spark, SF)), QUERIES["cores_and_attachments"](spark, SF)), (made(3), P.published_sets(edges_of(spark, made(3)), "cores_and_attachments"))):
        near = slow.network(rows)
        found = sets_in(got)
        assert found and len({frozenset(s) for s in found.values()}) == len(found)
        for s in found.values():
            assert len(slow.pieces(near, s)) == 1
            share = lambda c: sum(b in near[a] for a in c for b in c) / (len(c) * (len(c) - 1))
            grows = lambda core: set(core) | {x for y in core for x in near[y] if 2 * sum(z in core for z in near[x]) >= len(core)}
            cores = (c for k in range(len(s), 1, -1) for c in slow.itertools.combinations(sorted(s), k) if share(c) >= 0.7)
            assert any(grows(c) == s for c in cores)


def test_heaviest_pairs(spark):
    for rows, got in ((rows_of(V.kept(spark, SF)), QUERIES["heaviest_pairs"](spark, SF)), (made(4), P.heaviest_pairs(edges_of(spark, made(4))))):
        weight, near = {frozenset(r[:2]): r[2] for r in rows}, slow.network(rows)
        pairs = [(r.u, r.v) for r in got.collect()]
        assert len({x for p in pairs for x in p}) == 2 * len(pairs)
        want = sum(slow.heaviest([r for r in rows if r[0] in whole]) for whole in slow.pieces(near, near))
        assert sum(weight[frozenset(p)] for p in pairs) == pytest.approx(want)


def test_node_connectivity(spark):
    for rows, got in ((rows_of(V.kept(spark, SF).where("w >= 2")), QUERIES["node_connectivity"](spark, SF)), (made(5, 8), P.node_connectivity(edges_of(spark, made(5, 8))))):
        near = slow.network(rows)
        want = {}
        for whole in slow.pieces(near, near):
            sub = {x: {y for y in near[x] if y in whole} for x in whole}
            pairs = list(slow.itertools.combinations(sorted(whole), 2))
            want[min(whole)] = (len(whole), pytest.approx(sum(slow.disjoint_paths(sub, s, t) for s, t in pairs) / len(pairs)))
        assert {r.component: (r.n_nodes, r.connectivity) for r in got.collect()} == want


def returned(sets, hubs, weight, net, threshold):
    """hubs in order; weight and net by pair."""
    out = {}
    for m in sets:
        m = set(m)
        for h in hubs:
            if h not in m and sum(weight.get(frozenset((h, x)), 0) for x in m) / len(m) > threshold:
                m.add(h)
        inner = sum(w for k, w in net.items() if k <= m)
        if len(m) >= 2 and inner > 0:
            out.setdefault((frozenset(m), round(4 * inner / (len(m) * (len(m) - 1)), 6)), []).append(1)
    return {k: len(v) for k, v in out.items()}


def by_pair(rows):
    return {frozenset(r[:2]): r[2] for r in rows}


def found_with_scores(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.cid, [set(), round(r.score, 6)])[0].add(r.node)
    count = {}
    for m, s in out.values():
        count[frozenset(m), s] = count.get((frozenset(m), s), 0) + 1
    return count


def test_hub_return(spark):
    edges = cut(V.kept(spark, SF))
    rows = rows_of(edges)
    near = slow.network(rows)
    hubs = sorted((x for x in near if len(near[x]) >= 4), key=lambda x: (-len(near[x]), x))
    rest = slow.network([r for r in rows if r[0] not in hubs and r[1] not in hubs])
    sets = [s for whole in slow.pieces(rest, rest) for s in slow.coherent(rest, whole)]
    want = returned(sets, hubs, by_pair(rows_of(W.adjust_cd(edges))), by_pair(rows), 0.3)
    assert found_with_scores(QUERIES["hub_return"](spark, SF)) == want


def labelled_rows(spark, sizes):
    ev = cut(V.evidence(spark, SF))
    pairs = ev.select("u", "v").distinct()
    labels = E.label_sizes(pairs, V.preds(spark, SF)) if sizes else E.label_edges(pairs, V.preds(spark, SF))
    cls = {(r.u, r.v): r.cls for r in labels.collect()}
    return [((r.u, r.v), r.subtype, r.score) for r in ev.collect()], cls


def test_cut_points_and_features(spark):
    rows, cls = labelled_rows(spark, False)
    kinds = sorted({k for _, k, _ in rows})
    want = {k: " ".join(map(str, slow.mdl_cuts([(x, cls[p]) for p, kind, x in rows if kind == k]))) for k in kinds}
    assert {r.subtype: r.cuts for r in QUERIES["mdl_cutpoints"](spark, SF).collect()} == want
    rng = random.Random(1)
    for seed in range(12):  # clearer histograms too
        h = [(float(rng.randrange(9)), 0) for _ in range(40)]
        h = [(x, int(rng.random() < (0.9 if x > 4 + seed % 3 else 0.1))) for x, _ in h]
        value, c = zip(*h, strict=True)
        assert K.mdl_cuts(*map(slow.np.array, (value, c, [1.0] * len(h)))) == slow.mdl_cuts(h)
    chosen = kinds
    while True:
        live = [r for r in rows if r[1] in chosen and r[2] != 0]
        now = [k for k in chosen if slow.mdl_cuts([(x, cls[p]) for p, kind, x in live if kind == k], recursive=False)]
        if len(now) == len(chosen) or not now:
            break
        chosen = now
    assert sorted(r.subtype for r in QUERIES["selected_features"](spark, SF).collect()) == now


def test_three_class_scores(spark):
    """Every round learns from the evidence and the isolatedness (which SQL states) of the scores of the round before."""
    rows, cls = labelled_rows(spark, True)
    classes = sorted(set(cls.values()))
    ev = cut(V.evidence(spark, SF))
    labels = cut(E.label_sizes(ev.select("u", "v").distinct(), V.preds(spark, SF)))
    before = None
    for step in range(3):
        current = rows if before is None else rows + [((r.u, r.v), "ISO2", r.iso) for r in E.isolatedness(before).collect()]
        before = cut(E.iso_em(ev, labels, rounds=step))
        cuts = {k: slow.mdl_cuts([(x, cls[p]) for p, kind, x in current if kind == k]) for k in {k for _, k, _ in current}}
        binned = [(p, k, sum(c < x for c in cuts[k])) for p, k, x in current]
        cells = {(k, b) for _, k, b in binned}
        table = {}
        for k, b in cells:
            for c in classes:
                n = sum(kind == k and at == b and cls[p] == c for p, kind, at in binned)
                table[k, b, c] = (n + 1) / (sum(v == c for v in cls.values()) + sum(kind == k for kind, _ in cells))
        want = {}
        for p in {p for p, _, _ in binned}:
            x = {c: sum(v == c for v in cls.values()) / len(cls) for c in classes}
            for own, k, b in binned:
                if own == p:
                    x = {c: x[c] * table[k, b, c] for c in classes}
            want[p] = tuple(pytest.approx(x.get(c, 0.0) / sum(x.values()), abs=2e-6) for c in (0, 2, 4))
        assert {(r.u, r.v): (r.s0, r.s2, r.s4) for r in before.collect()} == want, step
    got = {(r.u, r.v): (r.s0, r.s2, r.s4) for r in QUERIES["iso_em_scores"](spark, SF).collect()}
    assert got == want


def plain_sets(near, method):
    return {min(s) if method != "cohesive" else f"{sorted(s)}": s for whole in slow.pieces(near, near) for s in {"coherent": slow.coherent, "cohesive": slow.cohesive, "complement": lambda n, w: slow.complement(n, w, K.min_cut)}[method](near, whole)}


def test_single_pipeline(spark):
    rows, refs = rows_of(V.kept(spark, SF)), sets_in(V.refs(spark, SF))
    near = slow.network(rows)
    got = {r.method: r for r in QUERIES["pipeline_single"](spark, SF).collect()}
    for method in pipelines.METHODS:
        sets = {c: s for c, s in plain_sets(near, method).items() if len(s) > 1}
        kept = greedy(sorted(sets), lambda a, b: aware(sets[a], sets[b]) >= 0.75)  # noqa: B023
        like = lambda a, b: len(a & b) / len(a | b) >= 0.5
        precision = sum(any(like(sets[c], r) for r in refs.values()) for c in kept) / len(kept)
        recall = sum(any(like(sets[c], r) for c in kept) for r in refs.values()) / len(refs)
        r = got[method]
        assert (r.n_preds, r.n_refs, r.precision, r.recall) == (len(kept), len(refs), pytest.approx(precision, abs=1e-6), pytest.approx(recall, abs=1e-6))


def test_ensemble_pipeline(spark, monkeypatch):
    """What goes into the evaluation: both partitions with hubs given back, and the cohesive sets."""
    seen = {}

    def evaluate(scored, sets, *rest):
        seen["sets"], seen["scored"] = sets_in(sets), {r.cid: r.score for r in scored.collect()}
        return scored

    monkeypatch.setattr(pipelines, "evaluate", evaluate)
    net = cut(V.net(spark, SF))
    pipelines.ensemble(net, V.refs(spark, SF), V.neg(spark, SF), "n", "g")
    rows = rows_of(FL.keep_pairs(FL.drop_listed(net, V.neg(spark, SF)), V.refs(spark, SF)))
    edges = edges_of(spark, rows)
    near = slow.network(rows)
    hubs = [r.node for r in sorted(P.hubs(edges).collect(), key=lambda r: (-r.degree, r.node))]
    rest = slow.network([r for r in rows if r[0] not in hubs and r[1] not in hubs])
    weight, pairs, whole = by_pair(rows_of(W.adjust_cd(edges))), by_pair(rows), by_pair(rows_of(net))
    for method in ("coherent", "complement"):
        mine = {}
        for c, m in seen["sets"].items():
            if c.startswith(method):
                key = frozenset(m), round(seen["scored"][c], 6)
                mine[key] = mine.get(key, 0) + 1
        assert mine == returned(plain_sets(rest, method).values(), hubs, weight, pairs, 0.3)
    own = {frozenset(m): seen["scored"][c] for c, m in seen["sets"].items() if c.startswith("cohesive")}
    assert shown(own) == shown(plain_sets(near, "cohesive").values())
    for m, score in own.items():
        first, n = min(m), len(m)
        inner = sum(w for k, w in whole.items() if k <= m)
        at_first = sum(w for k, w in whole.items() if k <= m and first in k)
        assert score == pytest.approx((4 * inner - 2 * at_first) / (n * (n - 1)))


def test_integrated_pipeline(spark, monkeypatch):
    """The clusterers' sets are those of the plain definitions, combined; every part reaches the integration; and its rules hold."""
    seen = {}
    real = C.integrate

    def integrate(scored, sets, factors, **options):
        seen["scored"], seen["sets"], seen["factors"] = scored.collect(), sets_in(sets), factors
        return real(scored, sets, factors, **options)

    monkeypatch.setattr(C, "integrate", integrate)
    got = {r.cid: (r.score, r.sources) for r in QUERIES["pipeline_integrated"](spark, SF).collect()}
    sources = {r.cid: r.src for r in seen["scored"]}
    assert "small" in sources.values()
    kept = {r.cid: r.score for r in seen["scored"] if r.score >= 1e-4 and (len(seen["sets"][r.cid]) >= 4 or r.src == "small")}
    weighed = {c: x * seen["factors"][sources[c]] for c, x in kept.items()}
    want = expected_groups_at(seen["sets"], {c: sources[c] for c in kept}, weighed, 0.75)
    assert {c: (pytest.approx(x, abs=1e-6), s) for c, (x, s) in want.items()} == got


def expected_groups_at(sets, src, score, threshold):
    plain = lambda a, b: min(len(sets[a]), len(sets[b])) > 3 and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold
    order = sorted(src, key=lambda c: (-score[c], c))
    order = [c for c in order if c in greedy(order, lambda a, b: src[a] == src[b] and plain(a, b))]
    kept, groups = [], {}
    for c in order:
        rep = next((k for k in kept if plain(c, k)), None)
        if rep is None:
            kept.append(c)
        g = groups.setdefault(rep or c, {})
        g[src[c]] = max(g.get(src[c], -1), score[c])
    return {k: (sum(g.values()), ",".join(sorted(g))) for k, g in groups.items()}


def test_clustered(spark):
    """Sets of four and more by all four methods, scored, deduplicated and grouped."""
    rows = made(9, 12, 0.5, 3)
    near, pairs = slow.network(rows), by_pair(rows)
    methods = {
        "cohesive": lambda n, w: slow.cohesive(n, w, 4, 0.0), "merged_cliques": slow.merged_cliques, "dense_growth": slow.dense_growth,
    }
    edges = edges_of(spark, rows)
    sets, src = {}, {}
    for method, found in {**methods, "cores_and_attachments": None}.items():
        named = sets_in(P.cohesive_sets(edges, least_size=4, density=0.0) if method == "cohesive" else P.published_sets(edges, method))
        if found:
            assert shown(named.values()) == shown(s for whole in slow.pieces(near, near) for s in found(near, whole))
        for c, s in named.items():
            if len(s) >= 4:
                sets[f"{method}:{c}"], src[f"{method}:{c}"] = s, method
    score = {c: 2 * sum(w for k, w in pairs.items() if k <= s) / (len(s) * (len(s) - 1)) for c, s in sets.items()}
    plain = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.75
    order = sorted(sets, key=lambda c: (-score[c], c))
    order = [c for c in order if c in greedy(order, lambda a, b: src[a] == src[b] and plain(a, b))]
    kept, groups = [], {}
    for c in order:
        rep = next((k for k in kept if plain(c, k)), None) or c
        kept += [c] if rep == c else []
        g = groups.setdefault(rep, {})
        g[src[c]] = max(g.get(src[c], -1), score[c])
    out = pipelines.clustered(edges).collect()
    assert {r.cid: r.score for r in out} == {c: pytest.approx(sum(g.values()) / 4) for c, g in groups.items()}
    assert sets_in(pipelines.clustered(edges)) == {c: sets[c] for c in groups}


def test_grid(spark):
    """The experiment grid: a row for each network, gold standard and method."""
    edges = edges_of(spark, made(6, 8, 0.5, 3))
    gold = spark.createDataFrame([("r1", f"a{i:02d}") for i in range(5)] + [("r2", f"b{i:02d}") for i in range(5)], "cid string, node string")
    got = pipelines.grid({"one": edges, "two": edges.where("w > 0.2")}, {"gold": gold}, "none").collect()
    assert sorted((r.network, r.gold, r.method) for r in got) == sorted((n, "gold", m) for n in ("one", "two") for m in pipelines.METHODS)
