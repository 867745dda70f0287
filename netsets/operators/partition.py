"""Partitions and matchings by kernels, one connected component a group: components are independent, and many run side by side.

A component is held by one task, so these take networks whose components fit one (denoised or decomposed ones), not a raw giant one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsets.functions.sets import bader
from netsets.operators import kernels, published
from netsets.operators.clusters import overlaps
from netsets.operators.graph import components, ranked_by_degree, without
from netsets.operators.matching import heaviest_matching
from netsets.operators.weights import p3_complement
from netsets.plans.lineage import cut

SETS = "cid string, node string"


def _named(names: list[str], found: list[int]) -> pd.DataFrame:
    """A set is called after its first node; sets of a partition never share one."""
    rows = []
    for mask in found:
        members = [names[i] for i in kernels.bits(mask)]
        rows += [(members[0], m) for m in members]
    return pd.DataFrame(rows, columns=["cid", "node"])


def _by_component(edges: DataFrame) -> DataFrame:
    return edges.join(components(edges).withColumnRenamed("node", "u"), "u").select("component", "u", "v", "w")


def coherent_partition(edges: DataFrame) -> DataFrame:
    """(cid, node): coherent neighbourhoods, taken out greedily."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        names, adj = kernels.graph(list(zip(frame.u, frame.v, strict=True)))
        return _named(names, kernels.coherent_partition(adj))

    return _by_component(edges).groupBy("component").applyInPandas(run, SETS)


def complement_partition(edges: DataFrame, published: bool = False) -> DataFrame:
    """(cid, node): minimum cuts of the path-weighted complement. Absent pairs and edges of a component meet in one group."""
    absent = p3_complement(edges).withColumn("absent", F.lit(True))
    both = absent.unionByName(_by_component(edges).withColumn("absent", F.lit(False)))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        inside, out = frame[~frame.absent], frame[frame.absent]
        names, adj = kernels.graph(list(zip(inside.u, inside.v, strict=True)))
        if len(names) <= 3:
            return _named(names, [(1 << len(names)) - 1])
        at = {x: i for i, x in enumerate(names)}
        weight = np.full((len(names), len(names)), np.nan)
        for u, v, w in zip(out.u, out.v, out.w, strict=True):
            weight[at[u], at[v]] = weight[at[v], at[u]] = w
        return _named(names, kernels.complement_partition(adj, weight, published))

    return both.groupBy("component").applyInPandas(run, SETS)


def cohesive_sets(edges: DataFrame, least_size: int = 3, density: float = 0.3, penalty: float = 2.0, overlap: float = 0.8) -> DataFrame:
    """(cid, node): overlapping sets grown by cohesiveness."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*frame.u, *frame.v})
        at = {x: i for i, x in enumerate(names)}
        edges = [(at[u], at[v], float(w)) for u, v, w in zip(frame.u, frame.v, frame.w, strict=True)]
        rows = []
        for k, s in enumerate(kernels.cohesive_sets(len(names), edges, penalty, least_size, density, overlap)):
            rows += [(f"{names[0]}#{k}", names[i]) for i in sorted(s)]
        return pd.DataFrame(rows, columns=["cid", "node"])

    return _by_component(edges).groupBy("component").applyInPandas(run, SETS)


def published_sets(edges: DataFrame, method: str, **options) -> DataFrame:
    """(cid, node): overlapping sets by merged_cliques, dense_growth or cores_and_attachments."""
    if method not in ("merged_cliques", "dense_growth", "cores_and_attachments"):
        raise ValueError(method)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        names, adj = kernels.graph(list(zip(frame.u, frame.v, strict=True)))
        if method == "merged_cliques":
            at = {x: i for i, x in enumerate(names)}
            weight = {(at[u], at[v]): float(w) for u, v, w in zip(frame.u, frame.v, frame.w, strict=True)}
            found = published.merged_cliques(adj, weight, **options)
        else:
            found = getattr(published, method)(adj, **options)
        rows = [(f"{names[0]}#{k}", names[i]) for k, mask in enumerate(found) for i in kernels.bits(mask)]
        return pd.DataFrame(rows, columns=["cid", "node"])

    return _by_component(edges).groupBy("component").applyInPandas(run, SETS)


def hub_threshold(edges: DataFrame) -> DataFrame:
    """n_top, threshold: the rank at which the top nodes' largest component jumps up most, and the degree there (0: no jump).

    The search is sequential in rank: it gets node numbers and edges between them in one group, two integers an edge.
    """
    edges = cut(edges)
    ranked = cut(ranked_by_degree(edges))
    a, b = ranked.select(F.col("node").alias("u"), (F.col("place") - 1).alias("a")), ranked.select(F.col("node").alias("v"), (F.col("place") - 1).alias("b"))
    pairs = edges.select("u", "v").join(a, "u").join(b, "v").select(F.lit(0).alias("g"), "a", "b")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        n = int(max(frame.a.max(), frame.b.max())) + 1
        return pd.DataFrame({"n_top": [kernels.hub_cut(n, list(zip(frame.a, frame.b, strict=True)))]})

    top = pairs.groupBy("g").applyInPandas(run, "n_top long")
    at = ranked.select("place", "degree")
    return top.join(at, top.n_top == at.place, "left").select("n_top", F.coalesce("degree", F.lit(0)).alias("threshold"))


def hubs(edges: DataFrame) -> DataFrame:
    """node, degree of the nodes at or above the found threshold."""
    ranked = ranked_by_degree(edges).select("node", "degree")
    return ranked.join(F.broadcast(hub_threshold(edges).select("threshold"))).where("degree >= threshold").select("node", "degree")


def without_hubs(edges: DataFrame, found: DataFrame) -> DataFrame:
    return without(edges, found)


def matching_ratio(preds_x: DataFrame, refs_x: DataFrame, least: float = 0.2) -> DataFrame:
    """total, n_refs, ratio: heaviest one-to-one matching of predictions and references by squared overlap over the product of
    sizes, above `least`, over the number of references. Matchings of the components of the pair graph add up."""
    pairs = overlaps(preds_x, refs_x).withColumn("w", bader(F.col("both"), F.col("na"), F.col("nb"))).where(F.col("w") > least)
    pairs = cut(pairs.select(F.concat(F.lit("p:"), "a").alias("u"), F.concat(F.lit("r:"), "b").alias("v"), "w"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows, cols = sorted(set(frame.u)), sorted(set(frame.v))
        weight = np.zeros((len(rows), len(cols)))
        ri, ci = {x: i for i, x in enumerate(rows)}, {x: i for i, x in enumerate(cols)}
        for u, v, w in zip(frame.u, frame.v, frame.w, strict=True):
            weight[ri[u], ci[v]] = w
        return pd.DataFrame({"total": [kernels.best_assignment(weight)[0]]})

    total = _by_component(pairs).groupBy("component").applyInPandas(run, "total double").agg(F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"))
    n = refs_x.agg(F.countDistinct("cid").alias("n_refs"))
    return total.join(F.broadcast(n)).select("total", "n_refs", (F.col("total") / F.col("n_refs")).alias("ratio"))


def heaviest_pairs(edges: DataFrame) -> DataFrame:
    """(u, v): a matching of greatest total weight in any network, odd circles included; components are matched apart."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        pairs = heaviest_matching(zip(frame.u, frame.v, frame.w.astype(float), strict=True))
        return pd.DataFrame(pairs, columns=["u", "v"])

    return _by_component(edges).groupBy("component").applyInPandas(run, "u string, v string")


def node_connectivity(edges: DataFrame) -> DataFrame:
    """component, n_nodes, connectivity: mean over node pairs of the number of node-disjoint paths. For small components."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        names, adj = kernels.graph(list(zip(frame.u, frame.v, strict=True)))
        n = len(names)
        total = sum(_disjoint_paths(adj, s, t) for s in range(n) for t in range(s))
        return pd.DataFrame({"component": [frame.component.iloc[0]], "n_nodes": [n], "connectivity": [2 * total / (n * (n - 1))]})

    return _by_component(edges).groupBy("component").applyInPandas(run, "component string, n_nodes long, connectivity double")


def _disjoint_paths(adj: list[int], s: int, t: int) -> int:
    """Unit flows through split nodes (in 2i, out 2i + 1)."""
    cap: dict[tuple[int, int], int] = {}
    for i in range(len(adj)):
        cap[2 * i, 2 * i + 1] = len(adj) if i in (s, t) else 1
        for j in kernels.bits(adj[i]):
            cap[2 * i + 1, 2 * j] = 1
    near: dict[int, set[int]] = {}
    for a, b in cap:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    flow = 0
    while True:
        back, queue = {2 * s: None}, [2 * s]
        for a in queue:
            for b in near.get(a, ()):
                if b not in back and cap.get((a, b), 0) > 0:
                    back[b] = a
                    queue.append(b)
        if 2 * t + 1 not in back:
            return flow
        at = 2 * t + 1
        while back[at] is not None:
            cap[back[at], at] -= 1
            cap[at, back[at]] = cap.get((at, back[at]), 0) + 1
            at = back[at]
        flow += 1
