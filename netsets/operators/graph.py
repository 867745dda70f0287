"""Network structure: edges(u, v, w) with u < v in, DataFrames out.

adj(src, dst, w) holds both directions. Triangles are found in blocks of edges between numbers; other nodes are numbered first.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsets.operators import blocks
from netsets.plans.lineage import cut


def canonical(pairs: DataFrame, u: str = "u", v: str = "v", w: str = "w", order: str | None = None) -> DataFrame:
    """Undirected edges u < v without loops; of repeated ones the last by `order` wins (else the largest weight)."""
    a, b = F.least(u, v), F.greatest(u, v)
    last = F.max_by(w, order) if order else F.max(w)
    return pairs.where(F.col(u) != F.col(v)).groupBy(a.alias("u"), b.alias("v")).agg(last.alias("w"))


def adjacency(edges: DataFrame) -> DataFrame:
    one = edges.select(F.col("u").alias("src"), F.col("v").alias("dst"), "w")
    return one.unionByName(edges.select(F.col("v").alias("src"), F.col("u").alias("dst"), "w"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("u", "v")).alias("node"), "w")
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("strength"))


def two_hop(edges: DataFrame) -> DataFrame:
    """node, n2: nodes within two steps, itself included when it has a neighbour."""
    adj = adjacency(edges).select("src", "dst")
    far = adj.join(adj.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", "far")
    return far.union(adj).distinct().groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n2"))


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends in kept(node)."""
    ends = kept.select("node").distinct()
    with_u = edges.join(ends.withColumnRenamed("node", "u"), "u", "left_semi")
    return with_u.join(ends.withColumnRenamed("node", "v"), "v", "left_semi").select("u", "v", "w")


def without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges with no end in gone(node)."""
    ends = gone.select("node").distinct()
    left = edges.join(ends.withColumnRenamed("node", "u"), "u", "left_anti")
    return left.join(ends.withColumnRenamed("node", "v"), "v", "left_anti").select("u", "v", "w")


def numbered(edges: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """codes (node, code), and the edges with codes for u and v; None and the edges themselves if their nodes are whole numbers."""
    if dict(edges.dtypes)["u"] in blocks.WHOLE:
        return None, edges
    codes = cut(nodes(edges).withColumn("code", F.monotonically_increasing_id()))
    cu, cv = (codes.select(F.col("node").alias(c), F.col("code").alias(f"c{c}")) for c in "uv")
    both = edges.join(cu, "u").join(cv, "v")
    return codes, both.select(F.col("cu").alias("u"), F.col("cv").alias("v"), *[c for c in edges.columns if c not in "uv"])


def triangles(edges: DataFrame) -> DataFrame:
    """a < b < c with the three weights wab, wac, wbc (of any type). Every triangle once."""
    kinds = dict(edges.dtypes)
    codes, coded_edges = numbered(edges)
    carried = ["w"] if kinds["w"] == "double" else []
    tri = blocks.listed(blocks.packed_rows(coded_edges, carried), len(carried))
    for c in "abc":
        tri = tri.join(codes.select(F.col("code").alias(c), F.col("node").alias(f"n{c}")), c) if codes else tri.withColumn(f"n{c}", F.col(c).cast(kinds["u"]))
    tri = in_order(tri.select(*[F.col(f"n{c}").alias(c) for c in "abc"], *[F.col(f"{p}0").alias(f"w{p}") for p in ("ab", "ac", "bc") if carried]))
    if not carried:
        for p, q in ("ab", "ac", "bc"):
            tri = tri.join(edges.select(F.col("u").alias(p), F.col("v").alias(q), F.col("w").alias(f"w{p}{q}")), [p, q])
    return tri.select("a", "b", "c", "wab", "wac", "wbc")


def in_order(tri: DataFrame) -> DataFrame:
    """The nodes a < b < c whatever their order was, and with them the weights wab, wac, wbc, if there are any."""
    a, b, c = (F.col(n) for n in "abc")
    low, high = F.least(a, b, c), F.greatest(a, b, c)
    mid = F.when((a > low) & (a < high), a).when((b > low) & (b < high), b).otherwise(c)

    def apart(node):
        """The weight of the edge that does not touch the node."""
        return F.when(node == a, F.col("wbc")).when(node == b, F.col("wac")).otherwise(F.col("wab"))

    weights = [apart(n).alias(w) for n, w in ((high, "wab"), (mid, "wac"), (low, "wbc"))] if "wab" in tri.columns else []
    return tri.select(low.alias("a"), mid.alias("b"), high.alias("c"), *weights)


def clustering(edges: DataFrame) -> DataFrame:
    """node, degree, triangles, coefficient."""
    kind = dict(edges.dtypes)["u"]
    codes, coded_edges = numbered(edges)
    found = blocks.counts(blocks.packed_rows(coded_edges, []))
    named = found.withColumnRenamed("node", "code").join(codes, "code") if codes else found.withColumn("node", F.col("node").cast(kind))
    pairs = F.col("degree") * (F.col("degree") - 1)
    return named.select("node", "degree", "triangles", F.when(pairs > 0, 2 * F.col("triangles") / pairs).otherwise(F.lit(0.0)).alias("coefficient"))


#: Links between stars that one task may finish; more are contracted by joins first.
FINISH_LINKS = 200_000


def _finish(links: DataFrame) -> DataFrame:
    """component, above from links (a, b) of a bounded number: union-find in one task."""

    def run(frames):
        up: dict[str, str] = {}

        def find(x: str) -> str:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for frame in frames:
            for a, b in zip(frame["a"], frame["b"], strict=True):
                a, b = find(a), find(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        if up:
            yield pd.DataFrame({"component": list(up), "above": [find(x) for x in up]})

    return links.select(F.col("a").cast("string"), F.col("b").cast("string")).coalesce(1).mapInPandas(run, "component string, above string")


def components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """node, component: the smallest node (as text) of its component. Nodes hook to their smallest neighbour, hooks shorten to stars, and
    only links between stars remain, a checkpoint a round; once few are left, one task ends it."""
    edges = cut(edges.select(F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v")))
    links = cut(edges.where("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct())
    roots = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("component", F.col("node"))
    while (count := links.count()) > FINISH_LINKS:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("component"), F.least("a", "m").alias("above")))
        while True:
            higher = hooks.select(F.col("component").alias("above"), F.col("above").alias("top"))
            jumped = cut(hooks.join(higher, "above").select("component", F.col("top").alias("above"), (F.col("top") != F.col("above")).alias("moved")))
            hooks = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        roots = cut(_renamed(roots, hooks))
        a, b = (hooks.select(F.col("component").alias(c), F.col("above").alias(f"r{c}")) for c in "ab")
        links = links.join(a, "a").join(b, "b").where("ra <> rb")
        links = cut(links.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if count:
        roots = _renamed(roots, _finish(links))
    roots = cut(roots)
    if vertices is not None:
        alone = vertices.select("node").distinct().join(roots, "node", "left_anti")
        roots = roots.unionByName(alone.withColumn("component", F.col("node")))
    return roots


def _renamed(roots: DataFrame, hooks: DataFrame) -> DataFrame:
    return roots.join(hooks, "component", "left").select("node", F.coalesce("above", "component").alias("component"))


def relative_connectivity(edges: DataFrame) -> DataFrame:
    """n_nodes, n_components, largest, relative_connectivity: one row."""
    sizes = components(edges).groupBy("component").count()
    total, top = F.sum("count"), F.max("count")
    return sizes.agg(total.alias("n_nodes"), F.count(F.lit(1)).alias("n_components"), top.alias("largest"), (top / total).alias("relative_connectivity"))


def complement(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Absent pairs u < v inside each group of membership(node, component). Grows with the square of a group, as asked: restrict
    it to the groups that a partition method takes."""
    a = membership.select(F.col("node").alias("u"), "component")
    b = membership.select(F.col("node").alias("v"), "component")
    return a.join(b, "component").where("u < v").join(edges.select("u", "v"), ["u", "v"], "left_anti").select("component", "u", "v")


def hubs_fixed(edges: DataFrame, least: int) -> DataFrame:
    return degrees(edges).where(F.col("degree") >= least).select("node", "degree")


def hub_edges(edges: DataFrame, hubs: DataFrame) -> DataFrame:
    """Edges with an end among the hubs."""
    ends = hubs.select("node").distinct()
    kept = without(edges, ends)
    return edges.join(kept.select("u", "v"), ["u", "v"], "left_anti")


def degree_histogram(edges: DataFrame) -> DataFrame:
    return degrees(edges).groupBy("degree").agg(F.count(F.lit(1)).alias("n_nodes"))


def graph_stats(edges: DataFrame) -> DataFrame:
    """n_nodes, n_edges, n_components, mean_clustering: one row."""
    edges = cut(edges)
    size = edges.agg(F.count(F.lit(1)).alias("n_edges"))
    parts = relative_connectivity(edges).select("n_nodes", "n_components")
    mean = clustering(edges).agg(F.avg("coefficient").alias("mean_clustering"))
    return parts.join(F.broadcast(size)).join(F.broadcast(mean))


def diameter(edges: DataFrame) -> int:
    """The longest shortest path of any component: frontiers of all sources grow a step a round. For small networks."""
    adj = adjacency(edges).select("src", "dst")
    seen = frontier = cut(nodes(edges).select(F.col("node").alias("source"), "node"))
    steps = 0
    while True:
        frontier = frontier.join(adj, frontier.node == adj.src).select("source", F.col("dst").alias("node")).distinct()
        frontier = cut(frontier.join(seen, ["source", "node"], "left_anti"))
        if frontier.isEmpty():
            return steps
        steps += 1
        seen = cut(seen.unionByName(frontier))


def common_neighbours(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """u, v, x, wu, wv: what both ends of each pair (u, v) have an edge to, with the weights of these. Each pair is looked up from its end
    of lower degree, so a hub's neighbours are listed only for pairs of hubs."""
    adj = cut(adjacency(edges))
    deg = cut(adj.groupBy("src").agg(F.count(F.lit(1)).alias("degree")))
    du, dv = (deg.select(F.col("src").alias(c), F.col("degree").alias(f"d{c}")) for c in "uv")
    # an end without any edge has no common neighbour
    both = pairs.select("u", "v").join(du, "u").join(dv, "v")
    low = F.when(F.col("du") <= F.col("dv"), F.col("u")).otherwise(F.col("v"))
    high = F.when(F.col("du") <= F.col("dv"), F.col("v")).otherwise(F.col("u"))
    placed = both.select("u", "v", low.alias("low"), high.alias("high"))
    near = adj.select(F.col("src").alias("low"), F.col("dst").alias("x"), F.col("w").alias("wl"))
    far = adj.select(F.col("src").alias("high"), F.col("dst").alias("x"), F.col("w").alias("wh"))
    met = placed.join(near, "low").join(far, ["high", "x"])
    from_u = F.col("low") == F.col("u")
    return met.select("u", "v", "x", F.when(from_u, F.col("wl")).otherwise(F.col("wh")).alias("wu"), F.when(from_u, F.col("wh")).otherwise(F.col("wl")).alias("wv"))


def complete_triangles(edges: DataFrame, scored: DataFrame) -> DataFrame:
    """2-paths a - m - b of `edges` whose missing edge a - b is in scored(u, v, w): a, b, m, w, mean score of the three."""
    closing = cut(scored.select("u", "v", "w").join(edges.select("u", "v"), ["u", "v"], "left_anti"))
    met = common_neighbours(closing, edges).join(closing, ["u", "v"])
    score = (F.col("wu") + F.col("wv") + F.col("w")) / 3
    return met.select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("x").alias("m"), "w", score.alias("score"))


def top_edges(edges: DataFrame, k: int) -> DataFrame:
    return edges.orderBy(F.desc("w"), "u", "v").limit(k)


def ranked_by_degree(edges: DataFrame) -> DataFrame:
    """node, degree, place: by falling degree, then id. One ordered list of all nodes, as the hub search needs."""
    return degrees(edges).select("node", "degree").withColumn("place", F.row_number().over(Window.orderBy(F.desc("degree"), "node")))
