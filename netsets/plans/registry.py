"""Every query of the network operators, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsets.functions.sets import bader, jaccard, size_aware_match
from netsets.operators import clusters as C
from netsets.operators import evidence as E
from netsets.operators import filters as FL
from netsets.operators import graph as G
from netsets.operators import metrics as M
from netsets.operators import ontology as O
from netsets.operators import partition as P
from netsets.operators import small_sets as S
from netsets.operators import weights as W
from netsets.plans import pipelines
from netsets.plans.lineage import cut
from netsets.sources import views as V
from netsets.sources.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(views: str = "", sql: str = "", recursive: bool = False):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(views, sql, recursive) if views else sql
        return f

    return register


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The columns, doubles rounded to six places."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, 6).alias(c) if kinds[c] == "double" else F.col(c) for c in columns])


def mixed(spark: SparkSession, sf: str) -> DataFrame:
    return V.preds(spark, sf).unionByName(V.refs(spark, sf))


def baskets(spark: SparkSession, sf: str) -> DataFrame:
    return V.basket(spark, sf).select(F.col("o").cast("string").alias("cid"), "node")


def scored_sets(spark: SparkSession, sf: str, sets_x: DataFrame) -> DataFrame:
    """cid, score: weighted density on net in four decimals, so that both engines order sets alike."""
    return C.weighted_density(sets_x, V.net(spark, sf)).select("cid", F.round("score", 4).alias("score"))


def scored_mixed(spark: SparkSession, sf: str) -> DataFrame:
    src = F.when(F.size(F.split("cid", "/")) == 3, "preds").otherwise("refs")
    return cut(scored_sets(spark, sf, mixed(spark, sf)).withColumn("src", src))


# Fixed SQL parts that several oracles share.
DENSITY = """dens_{0} AS (
    SELECT s.cid, s.size, round(CASE WHEN s.size > 1 THEN 2 * coalesce(i.w, 0) / (s.size * (s.size - 1)) ELSE 0 END, 4) AS score
    FROM (SELECT cid, count(DISTINCT node) AS size FROM {0} GROUP BY 1) s
    LEFT JOIN (SELECT a.cid, sum(w) AS w FROM net JOIN {0} a ON a.node = u JOIN {0} b ON b.node = v AND b.cid = a.cid GROUP BY 1) i USING (cid))"""
MIXED = "mixed AS (SELECT * FROM preds UNION ALL SELECT * FROM refs)"
BASKETS = "baskets AS (SELECT CAST(o AS VARCHAR) AS cid, node FROM basket)"
AWARE = "CASE WHEN na <= 3 AND nb <= 3 THEN CASE WHEN both_n = na AND both_n = nb THEN 1.0 ELSE 0 END WHEN na <= 3 OR nb <= 3 THEN 0 ELSE both_n / (na + nb - both_n)::DOUBLE END"
PAIRS = f"""sz AS (SELECT cid, count(*) AS n FROM mixed GROUP BY 1),
    mm AS (SELECT a.cid AS a, b.cid AS b, count(*) AS both_n, any_value(x.n) AS na, any_value(y.n) AS nb
           FROM mixed a JOIN mixed b ON a.node = b.node AND a.cid <> b.cid JOIN sz x ON x.cid = a.cid JOIN sz y ON y.cid = b.cid GROUP BY 1, 2),
    pairs AS (SELECT a, b FROM mm WHERE ({AWARE}) >= 0.5)"""
GREEDY = """ranked AS (SELECT cid, {0} AS src, score, row_number() OVER (ORDER BY {1}) AS r FROM dens_mixed),
    near AS (SELECT r, list(b) AS bs FROM ranked LEFT JOIN pairs ON a = cid GROUP BY 1),
    walk AS (SELECT 0::BIGINT AS r, []::VARCHAR[] AS kept
             UNION ALL SELECT k.r, CASE WHEN list_has_any(kept, coalesce(list_filter(bs, lambda x: x IS NOT NULL), []::VARCHAR[])) THEN kept ELSE list_append(kept, cid) END
             FROM walk JOIN ranked k ON k.r = walk.r + 1 JOIN near ON near.r = k.r),
    kept_sets AS (SELECT unnest(kept) AS cid FROM walk WHERE r = (SELECT max(r) FROM walk))"""
SRC = "CASE WHEN len(string_split(cid, '/')) = 3 THEN 'preds' ELSE 'refs' END"


# ---------------------------------------------------------------- sources and filters


@query("", """SELECT least(p, s) AS u, greatest(p, s) AS v, (max(struct_pack(a := l_orderkey, b := l_linenumber, c := l_quantity))).c AS w
    FROM (SELECT 'P' || l_partkey AS p, 'S' || l_suppkey AS s, * FROM lineitem) GROUP BY 1, 2""")  # fmt: skip
def canonical_edges(spark, sf):
    rows = V.table(spark, sf, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("u"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("v"),
        F.col("l_quantity").alias("w"), F.struct("l_orderkey", "l_linenumber", "l_quantity").alias("at"),
    )
    return G.canonical(rows, order="at")


@query("supp_net", "SELECT * FROM supp_net ORDER BY w DESC, u, v LIMIT 200")
def top_k_edges(spark, sf):
    return G.top_edges(V.supp_net(spark, sf), 200)


@query("net neg", "SELECT net.* FROM net ANTI JOIN neg USING (u, v)")
def negative_list_filter(spark, sf):
    return FL.drop_listed(V.net(spark, sf), V.neg(spark, sf))


@query("kept", "SELECT * FROM kept")
def per_pair_filter(spark, sf):
    return V.kept(spark, sf)


@query("net2 preds", "--ctes low AS (SELECT DISTINCT node FROM preds WHERE cid LIKE '%/low') SELECT * FROM net2 WHERE u IN (FROM low) AND v IN (FROM low)")
def per_member_filter(spark, sf):
    return FL.keep_members(V.net(spark, sf), V.preds(spark, sf).where("cid like '%/low'"), confidence=2.0)


@query("net2 preds", "--ctes low AS (SELECT DISTINCT node FROM preds WHERE cid LIKE '%/low') SELECT * FROM net2 WHERE u IN (FROM low) OR v IN (FROM low)")
def per_member_filter_either(spark, sf):
    return FL.keep_members(V.net(spark, sf), V.preds(spark, sf).where("cid like '%/low'"), confidence=2.0, either=True)


@query("net neg", "SELECT net.* FROM net JOIN neg USING (u, v)")
def direct_filter(spark, sf):
    return FL.keep_direct(V.net(spark, sf), V.neg(spark, sf))


@query("net", "SELECT * FROM net WHERE w >= 3")
def confidence_filter(spark, sf):
    return V.net(spark, sf).where("w >= 3")


@query("refs", "SELECT DISTINCT a.node AS u, b.node AS v FROM refs a JOIN refs b ON a.cid = b.cid AND a.node < b.node")
def sets_to_edges(spark, sf):
    return FL.set_pairs(V.refs(spark, sf))


@query("basket", f"--ctes {BASKETS}, hot AS (SELECT node FROM baskets GROUP BY 1 HAVING count(DISTINCT cid) > 1) SELECT * FROM baskets WHERE cid IN (SELECT cid FROM baskets JOIN hot USING (node))")
def overlapping_sets(spark, sf):
    return FL.overlapping_sets(baskets(spark, sf))


@query("preds refs", f"--ctes {MIXED} SELECT a.cid AS i, b.cid AS j, a.node FROM mixed a JOIN mixed b ON a.node = b.node AND a.cid < b.cid")
def shared_members(spark, sf):
    return FL.shared_members(mixed(spark, sf))


@query("basket", f"""--ctes {BASKETS}, keyed AS (SELECT cid, string_agg(node, ' ' ORDER BY node) AS key, count(*) AS size FROM baskets GROUP BY 1),
    one AS (SELECT key, min(cid) AS cid, any_value(size) AS size FROM keyed GROUP BY 1),
    mem AS (SELECT * FROM baskets WHERE cid IN (SELECT cid FROM one)),
    hot AS (SELECT node FROM mem GROUP BY 1 HAVING count(DISTINCT cid) > 1), over AS (SELECT DISTINCT cid FROM mem JOIN hot USING (node))
    SELECT CASE WHEN size <= 2 THEN 'small' WHEN cid IN (FROM over) THEN 'overlapping' ELSE 'regular' END AS kind, count(*) AS n_sets FROM one GROUP BY 1""")  # fmt: skip
def set_distribution(spark, sf):
    return FL.set_distribution(baskets(spark, sf))


@query("supp_net", """--ctes t AS (SELECT u, v, least(w, 100) AS w FROM supp_net ORDER BY least(w, 100) DESC, u, v LIMIT 1000)
    SELECT u, v, round(w / (SELECT max(w) FROM t), 6) AS w FROM t""")  # fmt: skip
def top_normalised(spark, sf):
    return rounded(FL.rescaled_top(V.supp_net(spark, sf), 1000, "norm"), "w")


@query("supp_net", """--ctes t AS (SELECT * FROM supp_net ORDER BY w DESC, u, v LIMIT 1000), m AS (SELECT min(w) AS a, max(w) AS b FROM t)
    SELECT u, v, round(a * 0.5 + (w - a) / (b - a) * (b - a * 0.5), 6) AS w FROM t, m""")  # fmt: skip
def top_stretched(spark, sf):
    return rounded(FL.rescaled_top(V.supp_net(spark, sf), 1000, "stretch", low=0.5), "w")


@query("supp_net", """--ctes t AS (SELECT * FROM supp_net ORDER BY w DESC, u, v LIMIT 1000),
    h AS (SELECT node FROM (SELECT u AS node FROM t UNION ALL SELECT v FROM t) GROUP BY 1 HAVING count(*) >= 25)
    SELECT * FROM t WHERE u NOT IN (FROM h) AND v NOT IN (FROM h)""")  # fmt: skip
def top_without_hubs(spark, sf):
    return FL.drop_hub_edges(V.supp_net(spark, sf), 1000, 25)


@query("supp_net", """--ctes t AS (SELECT *, row_number() OVER (ORDER BY w DESC, u, v) AS r FROM (SELECT * FROM supp_net ORDER BY w DESC, u, v LIMIT 1000)),
    walk AS (SELECT 0::BIGINT AS r, []::VARCHAR[] AS ends, []::BIGINT[] AS kept
             UNION ALL SELECT t.r, CASE WHEN ok THEN ends || [u, v] ELSE ends END, CASE WHEN ok THEN list_append(kept, t.r) ELSE kept END
             FROM (SELECT t.*, ends, kept, len(list_filter(ends, lambda x: x = u)) < 20 AND len(list_filter(ends, lambda x: x = v)) < 20 AS ok FROM walk JOIN t ON t.r = walk.r + 1) t)
    SELECT u, v, w FROM t WHERE r IN (SELECT unnest(kept) FROM walk WHERE r = (SELECT max(r) FROM walk))""", recursive=True)  # fmt: skip
def top_limited_degree(spark, sf):
    return FL.limit_degree(V.supp_net(spark, sf), 1000, 20)


@query("supp_net", "SELECT u, v, 1.0::DOUBLE AS w FROM supp_net ORDER BY md5('7|' || u || '|' || v), u, v LIMIT 500")
def sampled_edges(spark, sf):
    return FL.rescaled_top(V.supp_net(spark, sf), 500, "noweight", seed=7)


TOP = "--ctes t AS (SELECT * FROM supp_net ORDER BY w DESC, u, v LIMIT 1000)"


@query("supp_net", f"{TOP} SELECT u, v, round(w / (SELECT max(w) FROM t), 6) AS w FROM t")
def top_scaled(spark, sf):
    return rounded(FL.rescaled_top(V.supp_net(spark, sf), 1000, "scale"), "w")


@query("supp_net", f"{TOP} SELECT u, v, 1.0::DOUBLE AS w FROM t")
def top_flat(spark, sf):
    return FL.rescaled_top(V.supp_net(spark, sf), 1000, "topall1")


@query("supp_net", f"{TOP} SELECT * FROM t")
def top_as_it_is(spark, sf):
    return FL.rescaled_top(V.supp_net(spark, sf), 1000, "none")


@query("evidence", "SELECT * FROM evidence WHERE subtype IN ('SUPP', 'SIZE') AND score <> 0")
def kept_evidence(spark, sf):
    return FL.keep_evidence(V.evidence(spark, sf), ["SUPP", "SIZE"])


@query("evidence", "SELECT u, v, arg_min(score, CASE subtype WHEN 'SIZE' THEN 0 ELSE 1 END) AS w FROM evidence WHERE subtype <> 'ORDERS' AND score <> 0 GROUP BY 1, 2")
def first_values(spark, sf):
    return E.first_value(V.evidence(spark, sf), ["SIZE", "SUPP"])


@query("evidence", "SELECT DISTINCT u, v, 1.0::DOUBLE AS w FROM evidence WHERE subtype = 'SUPP' AND score <> 0")
def flat_values(spark, sf):
    return E.first_value(V.evidence(spark, sf), ["SUPP"], flat=True)


@query("evidence", "SELECT u, v, score AS w FROM evidence WHERE subtype = 'SUPP' ORDER BY score DESC, u, v LIMIT 100")
def subtype_top(spark, sf):
    return FL.subtype_edges(V.evidence(spark, sf), "SUPP", 100)


@query("evidence", "SELECT u, v, score AS w FROM evidence WHERE subtype = 'SUPP'")
def subtype_edges(spark, sf):
    return FL.subtype_edges(V.evidence(spark, sf), "SUPP")


@query("evidence", """SELECT u, v, coalesce(max(score) FILTER (subtype = 'ORDERS'), 0) AS ORDERS, coalesce(max(score) FILTER (subtype = 'SUPP'), 0) AS SUPP,
    coalesce(max(score) FILTER (subtype = 'SIZE'), 0) AS SIZE FROM evidence GROUP BY u, v""")  # fmt: skip
def pivot_evidence(spark, sf):
    return E.pivoted(V.evidence(spark, sf), ["ORDERS", "SUPP", "SIZE"])


@query("net2 preds", """--ctes low AS (SELECT * FROM preds WHERE cid LIKE 'Brand#1%'), nodes AS (SELECT DISTINCT node FROM low)
    SELECT u, v, CASE WHEN EXISTS (SELECT 1 FROM low a JOIN low b ON a.cid = b.cid WHERE a.node = u AND b.node = v) THEN 'complex'
        WHEN u IN (FROM nodes) OR v IN (FROM nodes) THEN 'border' ELSE 'outside' END AS label FROM net2""")  # fmt: skip
def edge_labels(spark, sf):
    return E.label_border(V.net2(spark, sf).select("u", "v"), V.preds(spark, sf).where("cid like 'Brand#1%'"))


@query("kept preds", """--ctes sz AS (SELECT cid, CASE WHEN count(*) >= 4 THEN 4 ELSE 2 END AS c FROM preds GROUP BY 1),
    t AS (SELECT u, v, max(c) AS cls FROM kept JOIN preds a ON a.node = u JOIN preds b ON b.node = v AND b.cid = a.cid JOIN sz ON sz.cid = a.cid GROUP BY 1, 2)
    SELECT kept.u, kept.v, coalesce(cls, 0)::INT AS cls FROM kept LEFT JOIN t USING (u, v)""")  # fmt: skip
def edge_size_labels(spark, sf):
    return E.label_sizes(V.kept(spark, sf), V.preds(spark, sf))


# ---------------------------------------------------------------- structure and weights


@query("deg:net", "SELECT node, degree, strength FROM deg_net")
def degrees(spark, sf):
    return G.degrees(V.net(spark, sf))


@query("adj:net2", """SELECT src AS node, count(DISTINCT far) AS n2 FROM (SELECT src, dst AS far FROM adj_net2
    UNION ALL SELECT a.src, b.dst FROM adj_net2 a JOIN adj_net2 b ON a.dst = b.src) GROUP BY 1""")  # fmt: skip
def two_hop_sizes(spark, sf):
    return G.two_hop(V.net2(spark, sf))


@query("net preds", "--ctes low AS (SELECT DISTINCT node FROM preds WHERE cid LIKE '%/low') SELECT * FROM net WHERE u IN (FROM low) AND v IN (FROM low)")
def induced_subgraph(spark, sf):
    return G.induced(V.net(spark, sf), V.preds(spark, sf).where("cid like '%/low'"))


REACH = "--ctes reach AS (SELECT src, src AS far FROM adj_kept UNION SELECT reach.src, dst FROM reach JOIN adj_kept a ON a.src = far), comp AS (SELECT src AS node, min(far) AS component FROM reach GROUP BY 1)"


@query("kept adj:kept", f"{REACH} SELECT * FROM comp", recursive=True)
def connected_components(spark, sf):
    return G.components(V.kept(spark, sf))


@query("kept adj:kept", f"""{REACH} SELECT sum(n)::BIGINT AS n_nodes, count(*) AS n_components, max(n) AS largest, round(max(n) / sum(n)::DOUBLE, 6) AS relative_connectivity
    FROM (SELECT count(*) AS n FROM comp GROUP BY component)""", recursive=True)  # fmt: skip
def relative_connectivity(spark, sf):
    return only(G.relative_connectivity(V.kept(spark, sf)), "n_nodes", "n_components", "largest", "relative_connectivity")


TRI = "tri AS (SELECT x.u AS a, x.v AS b, y.v AS c, x.w AS wab, z.w AS wac, y.w AS wbc FROM {0} x JOIN {0} y ON x.v = y.u JOIN {0} z ON z.u = x.u AND z.v = y.v)"


# each edge from its end of lower (degree, id), so that a hub's neighbours are never paired
ORIENTED = """arc AS MATERIALIZED (SELECT CASE WHEN a.degree < b.degree OR (a.degree = b.degree AND u < v) THEN u ELSE v END AS x, CASE WHEN a.degree < b.degree OR (a.degree = b.degree AND u < v) THEN v ELSE u END AS y
        FROM net JOIN deg_net a ON a.node = u JOIN deg_net b ON b.node = v),
    cor AS MATERIALIZED (SELECT list_sort([p.x, p.y, q.y]) AS t FROM arc p JOIN arc q ON p.x = q.x JOIN arc r ON r.x = p.y AND r.y = q.y)"""


@query("net deg:net", f"""--ctes {ORIENTED} SELECT t[1] AS a, t[2] AS b, t[3] AS c, ab.w AS wab, ac.w AS wac, bc.w AS wbc
    FROM cor JOIN net ab ON ab.u = t[1] AND ab.v = t[2] JOIN net ac ON ac.u = t[1] AND ac.v = t[3] JOIN net bc ON bc.u = t[2] AND bc.v = t[3]""")  # fmt: skip
def triangles(spark, sf):
    found = G.triangles(V.net(spark, sf, "bigint"))
    return G.in_order(found.withColumns({c: F.col(c).cast("string") for c in "abc"}))


@query("net deg:net", f"""--ctes {TRI.format('net')}, t AS (SELECT node, count(*) AS n FROM (SELECT a AS node FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT c FROM tri) GROUP BY 1)
    SELECT node, degree, coalesce(n, 0) AS triangles, round(CASE WHEN degree > 1 THEN 2 * coalesce(n, 0) / (degree * (degree - 1))::DOUBLE ELSE 0 END, 6) AS coefficient
    FROM deg_net LEFT JOIN t USING (node)""")  # fmt: skip
def clustering_coefficient(spark, sf):
    found = G.clustering(V.net(spark, sf, "bigint")).withColumn("node", F.col("node").cast("string"))
    return only(found, "node", "degree", "triangles", "coefficient")


@query("kept adj:kept deg:kept", f"""{REACH}, {TRI.format('kept')}, t AS (SELECT node, count(*) AS n FROM (SELECT a AS node FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT c FROM tri) GROUP BY 1)
    SELECT (SELECT count(*) FROM deg_kept) AS n_nodes, (SELECT count(*) FROM kept) AS n_edges, (SELECT count(DISTINCT component) FROM comp) AS n_components,
    (SELECT round(avg(CASE WHEN degree > 1 THEN 2 * coalesce(n, 0) / (degree * (degree - 1))::DOUBLE ELSE 0 END), 6) FROM deg_kept LEFT JOIN t USING (node)) AS mean_clustering""", recursive=True)  # fmt: skip
def graph_statistics(spark, sf):
    return only(G.graph_stats(V.kept(spark, sf)), "n_nodes", "n_edges", "n_components", "mean_clustering")


@query("kept adj:kept", f"""{REACH} SELECT a.component, a.node AS u, b.node AS v FROM comp a JOIN comp b ON a.component = b.component AND a.node < b.node
    ANTI JOIN kept ON kept.u = a.node AND kept.v = b.node""", recursive=True)  # fmt: skip
def component_complement(spark, sf):
    edges = cut(V.kept(spark, sf))
    return G.complement(edges, G.components(edges))


@query("net deg:net", "SELECT node, degree FROM deg_net WHERE degree >= 130")
def hubs_fixed(spark, sf):
    return G.hubs_fixed(V.net(spark, sf), 130)


@query("net deg:net", "--ctes h AS (SELECT node FROM deg_net WHERE degree >= 130) SELECT * FROM net WHERE u NOT IN (FROM h) AND v NOT IN (FROM h)")
def hub_removal(spark, sf):
    edges = cut(V.net(spark, sf))
    return G.without(edges, G.hubs_fixed(edges, 130))


@query("net deg:net", "--ctes h AS (SELECT node FROM deg_net WHERE degree >= 130) SELECT * FROM net WHERE u IN (FROM h) OR v IN (FROM h)")
def hub_edges(spark, sf):
    edges = cut(V.net(spark, sf))
    return G.hub_edges(edges, G.hubs_fixed(edges, 130))


@query("deg:net", "SELECT degree, count(*) AS n_nodes FROM deg_net GROUP BY 1")
def degree_histogram(spark, sf):
    return G.degree_histogram(V.net(spark, sf))


# nodes enter by rank; each takes the components of its earlier neighbours over, and the largest share of the nodes so far is compared with the one before
@query("kept adj:kept deg:kept", """--ctes rk AS MATERIALIZED (SELECT node, degree, row_number() OVER (ORDER BY degree DESC, node) AS r FROM deg_kept),
    back AS MATERIALIZED (SELECT a.r, list(b.r) FILTER (b.r < a.r) AS rs FROM rk a JOIN adj_kept ON src = a.node JOIN rk b ON b.node = dst GROUP BY 1),
    walk AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS labels
             UNION ALL SELECT back.r, list_append(list_transform(labels, lambda x: CASE WHEN list_contains(list_transform(coalesce(rs, []::BIGINT[]), lambda i: labels[i]), x) THEN back.r ELSE x END), back.r)
             FROM walk JOIN back ON back.r = walk.r + 1),
    one AS (SELECT r, unnest(labels) AS label FROM walk), share AS (SELECT r, max(n) / r::DOUBLE AS s FROM (SELECT r, label, count(*) AS n FROM one GROUP BY 1, 2) GROUP BY 1),
    jump AS (SELECT r, s - coalesce(lag(s) OVER (ORDER BY r), 1.0) AS j FROM share), top AS (SELECT arg_max(r, (j, -r)) AS r, max(j) AS j FROM jump)
    SELECT CASE WHEN j > 0 THEN top.r ELSE 0 END AS n_top, CASE WHEN j > 0 THEN degree ELSE 0 END AS threshold FROM top JOIN rk ON rk.r = top.r""", recursive=True)  # fmt: skip
def hub_threshold(spark, sf):
    return P.hub_threshold(V.kept(spark, sf))


# breadth first from every node; components of the kept network are far smaller than the bound on the steps
@query("kept adj:kept", """--ctes bfs AS (SELECT DISTINCT src AS s, src AS n, 0 AS d FROM adj_kept UNION SELECT s, dst, d + 1 FROM bfs JOIN adj_kept ON src = n WHERE d < 30)
    SELECT max(d)::INT AS diameter FROM (SELECT s, n, min(d) AS d FROM bfs GROUP BY 1, 2)""", recursive=True)  # fmt: skip
def network_diameter(spark, sf):
    return spark.createDataFrame([(G.diameter(V.kept(spark, sf)),)], "diameter int")


@query()
def node_connectivity(spark, sf):
    return P.node_connectivity(V.kept(spark, sf).where("w >= 2"))


@query("net net2 adj:net2", """--ctes n AS MATERIALIZED (FROM net), h AS MATERIALIZED (FROM adj_net2), p AS MATERIALIZED (SELECT a.dst AS a, b.dst AS b, a.src AS m, a.w + b.w AS w FROM h a JOIN h b ON a.src = b.src AND a.dst < b.dst)
    SELECT a, b, m, n.w, round((p.w + n.w) / 3, 6) AS score FROM p JOIN n ON n.u = a AND n.v = b WHERE n.w < 2""")  # fmt: skip
def triangle_completion(spark, sf):
    edges = cut(V.net(spark, sf))
    return only(G.complete_triangles(edges.where("w >= 2"), edges), "a", "b", "m", "w", "score")


@query("net deg:net", f"""--ctes {TRI.format('net')}, mean AS (SELECT avg(degree) AS m FROM deg_net), pad AS (SELECT node, degree::DOUBLE AS d, greatest(0, m - degree) AS p FROM deg_net, mean),
    com AS (SELECT a AS u, b AS v, c AS x FROM tri UNION ALL SELECT a, c, b FROM tri UNION ALL SELECT b, c, a FROM tri),
    one AS (SELECT net.u, net.v, coalesce(2 * n, 0) / (pu.d + pu.p + pv.d + pv.p) AS w FROM net LEFT JOIN (SELECT u, v, count(*)::DOUBLE AS n FROM com GROUP BY 1, 2) c USING (u, v)
            JOIN pad pu ON pu.node = net.u JOIN pad pv ON pv.node = net.v),
    s AS (SELECT node, sum(w) AS s FROM (SELECT u AS node, w FROM one UNION ALL SELECT v, w FROM one) GROUP BY 1),
    top AS (SELECT com.u, com.v, sum(a.w + b.w) AS t FROM com JOIN one a ON a.u = least(com.x, com.u) AND a.v = greatest(com.x, com.u)
            JOIN one b ON b.u = least(com.x, com.v) AND b.v = greatest(com.x, com.v) GROUP BY 1, 2)
    SELECT net.u, net.v, round(CASE WHEN su.s + pu.p + sv.s + pv.p > 0 THEN coalesce(t, 0) / (su.s + pu.p + sv.s + pv.p) ELSE 0 END, 6) AS w
    FROM net LEFT JOIN top USING (u, v) JOIN s su ON su.node = net.u JOIN s sv ON sv.node = net.v JOIN pad pu ON pu.node = net.u JOIN pad pv ON pv.node = net.v""")  # fmt: skip
def adjust_cd(spark, sf):
    found = W.adjust_cd(cut(V.net(spark, sf, "bigint")))
    u, v = F.col("u").cast("string"), F.col("v").cast("string")
    return rounded(found.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v"), "w"), "w")


ROUND = """top{k} AS (SELECT c.u, c.v, sum(a.w + b.w) AS t FROM com c JOIN w{j} a ON a.u = least(c.x, c.u) AND a.v = greatest(c.x, c.u) JOIN w{j} b ON b.u = least(c.x, c.v) AND b.v = greatest(c.x, c.v) GROUP BY 1, 2),
    s{j} AS (SELECT node, sum(w) AS s FROM (SELECT u AS node, w FROM w{j} UNION ALL SELECT v, w FROM w{j}) GROUP BY 1), p{j} AS (SELECT node, s + {pad} AS z FROM s{j} JOIN pad USING (node)),
    w{k} AS (SELECT kept.u, kept.v, CASE WHEN a.z + b.z > 0 THEN coalesce(t, 0) / (a.z + b.z) ELSE 0 END AS w FROM kept LEFT JOIN top{k} t USING (u, v) JOIN p{j} a ON a.node = kept.u JOIN p{j} b ON b.node = kept.v)"""


@query("kept deg:kept", f"""--ctes {TRI.format('kept')}, mean AS (SELECT avg(degree) AS m, count(*) AS nodes FROM deg_kept), pad AS (SELECT node, degree::DOUBLE AS d, greatest(0, m - degree) AS p FROM deg_kept, mean),
    com AS MATERIALIZED (SELECT a AS u, b AS v, c AS x FROM tri UNION ALL SELECT a, c, b FROM tri UNION ALL SELECT b, c, a FROM tri),
    w1 AS (SELECT kept.u, kept.v, coalesce(2 * n, 0) / (a.d + a.p + b.d + b.p) AS w FROM kept LEFT JOIN (SELECT u, v, count(*)::DOUBLE AS n FROM com GROUP BY 1, 2) c USING (u, v)
           JOIN pad a ON a.node = kept.u JOIN pad b ON b.node = kept.v),
    {ROUND.format(j=1, k=2, pad="p")},
    {ROUND.format(j=2, k=3, pad="greatest(0, (SELECT sum(s) FROM s2) / (SELECT nodes FROM mean) - s)")}
    SELECT u, v, round(w, 6) AS w FROM w3""")  # fmt: skip
def adjust_cd_three_rounds(spark, sf):
    return rounded(W.adjust_cd(cut(V.kept(spark, sf)), rounds=3), "w")


@query("kept adj:kept deg:kept", f"""{REACH}, p3 AS (SELECT a.src AS u, c.dst AS v, sum(1 / sqrt(da.degree * db.degree)) AS w FROM adj_kept a JOIN adj_kept b ON a.dst = b.src AND b.dst <> a.src
    JOIN adj_kept c ON c.src = b.dst AND c.dst <> a.dst AND a.src < c.dst JOIN deg_kept da ON da.node = a.dst JOIN deg_kept db ON db.node = b.dst GROUP BY 1, 2)
    SELECT a.component, a.node AS u, b.node AS v, round(coalesce(p3.w, 0), 6) AS w FROM comp a JOIN comp b ON a.component = b.component AND a.node < b.node
    LEFT JOIN p3 ON p3.u = a.node AND p3.v = b.node ANTI JOIN kept ON kept.u = a.node AND kept.v = b.node""", recursive=True)  # fmt: skip
def p3_nonedges(spark, sf):
    return rounded(W.p3_complement(cut(V.kept(spark, sf))), "w")


# ---------------------------------------------------------------- sets


@query("net preds", f"--ctes {DENSITY.format('preds')} SELECT cid, size, score FROM dens_preds")
def weighted_density(spark, sf):
    return C.weighted_density(V.preds(spark, sf), V.net(spark, sf)).withColumn("score", F.round("score", 4))


@query("net preds", f"--ctes {DENSITY.format('preds').replace('THEN 2 *', 'THEN 4 *')} SELECT cid, size, score FROM dens_preds")
def doubled_density(spark, sf):
    return C.weighted_density(V.preds(spark, sf), V.net(spark, sf), doubled=True).withColumn("score", F.round("score", 4))


@query("net preds", f"--ctes {DENSITY.format('preds').replace('sum(w) AS w', 'count(*) AS w').replace('2 * coalesce(i.w, 0)', '2 * coalesce(i.w, 0)::DOUBLE')} SELECT cid, size, score FROM dens_preds")
def edge_density(spark, sf):
    return C.weighted_density(V.preds(spark, sf), V.net(spark, sf), count=True).withColumn("score", F.round("score", 4))


@query("net preds", """--ctes head AS (SELECT cid, min(node) AS h, count(*) AS n FROM preds GROUP BY 1),
    i AS (SELECT a.cid, sum(w) AS w, sum(CASE WHEN u = h OR v = h THEN w ELSE 0 END) AS w0 FROM net JOIN preds a ON a.node = u JOIN preds b ON b.node = v AND b.cid = a.cid JOIN head ON head.cid = a.cid GROUP BY 1)
    SELECT cid, n AS size, round(CASE WHEN n > 1 THEN (4 * coalesce(w, 0) - 2 * coalesce(w0, 0)) / (n * (n - 1)) ELSE 0 END, 4) AS score FROM head LEFT JOIN i USING (cid)""")  # fmt: skip
def ordered_density(spark, sf):
    listed = V.preds(spark, sf).groupBy("cid").agg(F.sort_array(F.collect_list("node")).alias("m"))
    sets = listed.select("cid", F.posexplode("m").alias("pos", "node"))
    return C.ordered_density(sets, V.net(spark, sf)).withColumn("score", F.round("score", 4))


@query("net preds adj:net", """--ctes i AS (SELECT a.cid, sum(w) AS w FROM net JOIN preds a ON a.node = u JOIN preds b ON b.node = v AND b.cid = a.cid GROUP BY 1),
    e AS (SELECT cid, sum(w) AS w FROM preds JOIN adj_net ON src = node GROUP BY 1), s AS (SELECT cid, count(*) AS n FROM preds GROUP BY 1)
    SELECT cid, n AS size, round(CASE WHEN n > 1 AND e.w - coalesce(i.w, 0) > 0 THEN coalesce(i.w, 0) / (e.w - coalesce(i.w, 0)) * 2 * coalesce(i.w, 0) / (n * (n - 1)) ELSE 0 END, 6) AS score
    FROM s LEFT JOIN i USING (cid) LEFT JOIN e USING (cid)""")  # fmt: skip
def coherence_score(spark, sf):
    return rounded(C.coherence(V.preds(spark, sf), V.net(spark, sf)), "score")


def _overlap_scores(spark, sf, f):
    o = C.overlaps(V.preds(spark, sf), V.refs(spark, sf))
    return o.select("a", "b", F.round(f(F.col("both"), F.col("na"), F.col("nb")), 6).alias("score"))


@query("ov", "SELECT a, b, round(both_n / (na + nb - both_n)::DOUBLE, 6) AS score FROM ov")
def jaccard_pairs(spark, sf):
    return _overlap_scores(spark, sf, jaccard)


@query("ov", "SELECT a, b, round(both_n * both_n / (na * nb)::DOUBLE, 6) AS score FROM ov")
def bader_pairs(spark, sf):
    return _overlap_scores(spark, sf, bader)


@query("ov", f"SELECT a, b, round({AWARE}, 6) AS score FROM ov")
def size_aware_pairs(spark, sf):
    return _overlap_scores(spark, sf, size_aware_match)


def _greedy_sql(order: str, body: str) -> str:
    return f"--ctes {MIXED}, {DENSITY.format('mixed')}, {PAIRS}, {GREEDY.format(SRC, order)} {body}"


@query("net preds refs", _greedy_sql("cid", "SELECT cid, score FROM dens_mixed WHERE cid IN (FROM kept_sets)"), recursive=True)
def dedup_greedy(spark, sf):
    return C.dedup(scored_mixed(spark, sf), mixed(spark, sf), 0.5).select("cid", "score")


@query("net preds refs", _greedy_sql("score DESC, cid", "SELECT cid, score FROM dens_mixed WHERE cid IN (FROM kept_sets)"), recursive=True)
def dedup_by_score(spark, sf):
    return C.dedup(scored_mixed(spark, sf), mixed(spark, sf), 0.5, by_score=True).select("cid", "score")


@query("basket", f"--ctes {BASKETS} SELECT min(cid) AS cid FROM (SELECT cid, string_agg(node, ' ' ORDER BY node) AS key FROM baskets GROUP BY 1) GROUP BY key")
def dedup_exact(spark, sf):
    return C.dedup_exact(baskets(spark, sf))


@query("net preds refs", f"--ctes {MIXED}, {DENSITY.format('mixed')} SELECT split_part(cid, '/', 1) AS cid, arg_max(score, (score, cid)) AS score FROM dens_mixed GROUP BY 1")
def dedup_by_id(spark, sf):
    rows = scored_mixed(spark, sf).select(F.split("cid", "/")[0].alias("cid"), "score")
    return C.dedup_by_id(rows, F.desc("score")).select("cid", "score")


@query("net preds refs", f"""--ctes {MIXED}, {DENSITY.format('mixed')}, {PAIRS}, s AS (SELECT cid, {SRC} AS src, score FROM dens_mixed),
    m AS (SELECT x.cid AS a, x.score AS wa, y.src, min(y.cid) AS b FROM pairs JOIN s x ON x.cid = a JOIN s y ON y.cid = b WHERE x.src <> y.src GROUP BY 1, 2, 3),
    t AS (SELECT a, wa, max(struct_pack(w := s.score, b := m.b)) AS m FROM m JOIN s ON s.cid = m.b GROUP BY 1, 2)
    SELECT DISTINCT CASE WHEN m.w > wa THEN m.b ELSE a END AS cid FROM t""")  # fmt: skip
def vote_ensemble(spark, sf):
    return C.vote(scored_mixed(spark, sf), mixed(spark, sf), 0.5)


@query("net preds refs", f"--ctes {MIXED}, {DENSITY.format('mixed')} SELECT cid, {SRC} AS src, score FROM dens_mixed WHERE score > 0.05")
def reliable_concatenation(spark, sf):
    return scored_mixed(spark, sf).where("score > 0.05").select("cid", "src", "score")


def _walk(k: int, rows: str, pairs: str) -> str:
    """kept{k}: the sets that a pass over `rows` in score order keeps."""
    return f"""ranked{k} AS (SELECT cid, src, score, row_number() OVER (ORDER BY score DESC, cid) AS r FROM {rows}),
    near{k} AS (SELECT r, list(b) AS bs FROM ranked{k} LEFT JOIN {pairs} ON a = cid GROUP BY 1),
    walk{k} AS (SELECT 0::BIGINT AS r, []::VARCHAR[] AS kept
             UNION ALL SELECT k.r, CASE WHEN list_has_any(kept, coalesce(list_filter(bs, lambda x: x IS NOT NULL), []::VARCHAR[])) THEN kept ELSE list_append(kept, cid) END
             FROM walk{k} JOIN ranked{k} k ON k.r = walk{k}.r + 1 JOIN near{k} near ON near.r = k.r),
    kept{k} AS (SELECT unnest(kept) AS cid FROM walk{k} WHERE r = (SELECT max(r) FROM walk{k}))"""


def _combined_sql(rows: str, over: int, body: str) -> str:
    """Each source deduplicated, then all sets grouped around representatives."""
    return f"""--ctes {MIXED}, {DENSITY.format('mixed')}, {PAIRS}, src_rows AS ({rows}),
    jp AS (SELECT a, b FROM mm WHERE both_n / (na + nb - both_n)::DOUBLE >= 0.5 AND na > {over} AND nb > {over}),
    alone AS (SELECT a, b FROM jp JOIN src_rows x ON x.cid = a JOIN src_rows y ON y.cid = b WHERE x.src = y.src),
    {_walk(1, 'src_rows', 'alone')}, rows2 AS (SELECT * FROM src_rows WHERE cid IN (FROM kept1)), {_walk(2, 'rows2', 'jp')},
    firsts AS (SELECT k.cid, k.src, k.score, arg_min(p.cid, p.r) AS rep FROM ranked2 k JOIN jp ON a = k.cid JOIN ranked2 p ON p.cid = b AND p.r < k.r AND p.cid IN (FROM kept2)
        WHERE k.cid NOT IN (FROM kept2) GROUP BY 1, 2, 3),
    best AS (SELECT rep, src, max(score) AS score FROM (SELECT cid AS rep, src, score FROM ranked2 WHERE cid IN (FROM kept2) UNION ALL SELECT rep, src, score FROM firsts) GROUP BY 1, 2) {body}"""


ALL_ROWS = f"SELECT cid, {SRC} AS src, score FROM dens_mixed"


@query("net preds refs", _combined_sql(ALL_ROWS, 0, "SELECT rep AS cid, round(sum(score) / 2, 6) AS score, string_agg(src, ',' ORDER BY src) AS sources FROM best GROUP BY 1"), recursive=True)
def combine_sources(spark, sf):
    return rounded(C.combine(scored_mixed(spark, sf), mixed(spark, sf), 2, 0.5), "score")


@query("net preds refs", _combined_sql(ALL_ROWS, 0, "SELECT rep AS cid, round(max(score), 6) AS score, string_agg(src, ',' ORDER BY src) AS sources FROM best GROUP BY 1"), recursive=True)
def combine_best(spark, sf):
    return rounded(C.combine(scored_mixed(spark, sf), mixed(spark, sf), 2, 0.5, add=False), "score")


@query("net preds refs", _combined_sql(ALL_ROWS, 0, "SELECT n AS n_sources, count(*) AS n_sets FROM (SELECT rep, count(*)::INT AS n FROM best GROUP BY 1) GROUP BY 1"), recursive=True)
def source_overlap_histogram(spark, sf):
    return C.source_histogram(C.combine(scored_mixed(spark, sf), mixed(spark, sf), 2, 0.5))


WEIGHED = f"SELECT cid, src, score * CASE src WHEN 'refs' THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS score FROM ({ALL_ROWS}) JOIN sz USING (cid) WHERE score >= 1e-4"


@query("net preds refs", _combined_sql(f"{WEIGHED} AND n >= 4", 3, "SELECT rep AS cid, round(sum(score), 6) AS score, string_agg(src, ',' ORDER BY src) AS sources FROM best GROUP BY 1"), recursive=True)
def integrate_sources(spark, sf):
    return rounded(C.integrate(scored_mixed(spark, sf), mixed(spark, sf), {"preds": 1.0, "refs": 0.6}, 0.5), "score")


@query("net preds refs", _combined_sql(f"{WEIGHED} AND (n >= 4 OR src = 'preds')", 3, "SELECT rep AS cid, round(sum(score), 6) AS score, string_agg(src, ',' ORDER BY src) AS sources FROM best GROUP BY 1"), recursive=True)
def integrate_with_small(spark, sf):
    return rounded(C.integrate(scored_mixed(spark, sf), mixed(spark, sf), {"preds": 1.0, "refs": 0.6}, 0.5, small_from="preds"), "score")


@query("net preds refs", f"--ctes {MIXED}, {DENSITY.format('mixed')}, {PAIRS}, src_rows AS ({ALL_ROWS}), jp AS (SELECT a, b FROM mm WHERE both_n / (na + nb - both_n)::DOUBLE >= 0.5), {_walk(1, 'src_rows', 'jp')} SELECT cid, score FROM dens_mixed WHERE cid IN (FROM kept1)", recursive=True)
def dedup_plain(spark, sf):
    return C.dedup(scored_mixed(spark, sf), mixed(spark, sf), 0.5, by_score=True, aware=False).select("cid", "score")


@query("net preds refs", f"""--ctes {MIXED}, {DENSITY.format('mixed')}, {PAIRS}, src_rows AS (SELECT cid, {SRC} AS src, score FROM dens_mixed JOIN sz USING (cid) WHERE n >= 4 AND score >= 0.01),
    jp AS (SELECT a, b FROM mm WHERE both_n / (na + nb - both_n)::DOUBLE >= 0.5), {_walk(1, 'src_rows', 'jp')} SELECT cid, score, size FROM dens_mixed WHERE cid IN (FROM kept1) ORDER BY score DESC, cid LIMIT 50""", recursive=True)  # fmt: skip
def sets_for_evaluation(spark, sf):
    return C.for_evaluation(scored_mixed(spark, sf), mixed(spark, sf), small_only=False, least_score=0.01, unique_at=0.5, top=50).select("cid", "score", "size")


@query("basket", f"--ctes {BASKETS} SELECT count(*) AS n_sets, round(avg(n), 6) AS mean_size, round(stddev_pop(n), 6) AS std_size FROM (SELECT count(*) AS n FROM baskets GROUP BY cid)")
def size_statistics(spark, sf):
    return only(C.size_statistics(baskets(spark, sf)), "n_sets", "mean_size", "std_size")


@query("net preds", """--ctes t AS (SELECT split_part(cid, '/', 3) AS term, cid, node FROM preds UNION ALL SELECT 'zz', cid, node FROM preds),
    k AS (SELECT term, cid, string_agg(node, ' ' ORDER BY node) AS key FROM t GROUP BY 1, 2), f AS (SELECT key, min(term) AS term FROM k GROUP BY 1),
    s AS (SELECT t.term || '/' || t.cid AS cid, node FROM t JOIN k USING (term, cid) JOIN f USING (key, term))""" + f", {DENSITY.format('s')} SELECT cid, size, score FROM dens_s")  # fmt: skip
def recombine_terms(spark, sf):
    p = V.preds(spark, sf)
    rows = p.select(F.split("cid", "/")[2].alias("term"), "cid", "node").unionByName(p.select(F.lit("zz").alias("term"), "cid", "node"))
    return C.recombine(rows, V.net(spark, sf)).withColumn("score", F.round("score", 4))


@query("net preds deg:net adj:net", """--ctes h AS (SELECT node FROM deg_net WHERE degree >= 130), s AS (SELECT cid, count(*) AS n FROM preds GROUP BY 1)
    SELECT p.cid, dst AS node, round(sum(w) / n, 6) AS connectivity FROM preds p JOIN adj_net ON src = p.node JOIN h ON h.node = dst JOIN s ON s.cid = p.cid
    ANTI JOIN preds q ON q.cid = p.cid AND q.node = dst GROUP BY p.cid, dst, n HAVING sum(w) / n >= 0.3""")  # fmt: skip
def hub_readd_members(spark, sf):
    edges = cut(V.net(spark, sf))
    return rounded(C.hub_members(V.preds(spark, sf), G.hubs_fixed(edges, 130), edges, 0.3), "connectivity")


@query()
def hub_return(spark, sf):
    edges = cut(V.kept(spark, sf))
    hubs = cut(G.hubs_fixed(edges, 4))
    found = cut(P.coherent_partition(G.without(edges, hubs)))
    return rounded(C.return_hubs(found, hubs, W.adjust_cd(edges), edges), "score")


@query()
def coherent_partition(spark, sf):
    return P.coherent_partition(cut(V.kept(spark, sf)))


@query()
def complement_partition(spark, sf):
    return P.complement_partition(cut(V.kept(spark, sf)))


@query()
def heaviest_pairs(spark, sf):
    return P.heaviest_pairs(cut(V.kept(spark, sf)))


@query()
def cohesive_sets(spark, sf):
    return P.cohesive_sets(cut(V.kept(spark, sf)))


@query()
def merged_cliques(spark, sf):
    return P.published_sets(cut(V.kept(spark, sf)), "merged_cliques", least=3)


@query()
def dense_growth(spark, sf):
    return P.published_sets(cut(V.kept(spark, sf)), "dense_growth", least=3)


@query()
def cores_and_attachments(spark, sf):
    return P.published_sets(cut(V.kept(spark, sf)), "cores_and_attachments")


# ---------------------------------------------------------------- evaluation


@query("ov preds refs", """--ctes h AS (SELECT count(DISTINCT a) AS ha, count(DISTINCT b) AS hb FROM ov WHERE both_n / (na + nb - both_n)::DOUBLE >= 0.5),
    n AS (SELECT (SELECT count(DISTINCT cid) FROM preds) AS n_preds, (SELECT count(DISTINCT cid) FROM refs) AS n_refs),
    x AS (SELECT n_preds, n_refs, ha / n_preds::DOUBLE AS p, hb / n_refs::DOUBLE AS r FROM h, n)
    SELECT n_preds, n_refs, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1, round(4 * p * r / (5 * p + r), 6) AS f2 FROM x""")  # fmt: skip
def precision_recall(spark, sf):
    return only(M.precision_recall(V.preds(spark, sf), V.refs(spark, sf)), "n_preds", "n_refs", "precision", "recall", "f1", "f2")


def _curve_sql(steps: str, edges: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    col = f"{by}, " if by else ""
    return f"""run AS (SELECT {col}score, sum(np) OVER o AS n_preds, sum(nc) OVER o AS n_correct, sum(nr) OVER o / (SELECT count(DISTINCT cid) FROM refs)::DOUBLE AS recall FROM {steps}
        WINDOW o AS ({part}ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
    bucketed AS (SELECT *, len(list_filter({edges}, lambda e: e <= recall)) AS b FROM run),
    points AS (SELECT {col}score AS threshold, n_preds, n_correct / n_preds::DOUBLE AS precision, recall FROM (SELECT *, coalesce(max(b) OVER ({part}ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pb,
        lead(score) OVER ({part}ORDER BY score DESC) AS nxt FROM bucketed) WHERE b > pb OR nxt IS NULL)"""


STEPS = f"""m AS (SELECT a AS cid, b AS ref FROM ov WHERE ({AWARE}) >= 0.5), hits AS (SELECT m.*, score FROM m JOIN dens_preds USING (cid)),
    st AS (SELECT score, count(*) AS np, coalesce(any_value(nc), 0) AS nc, coalesce(any_value(nr), 0) AS nr FROM dens_preds
        LEFT JOIN (SELECT score, count(DISTINCT cid) AS nc FROM hits GROUP BY 1) USING (score)
        LEFT JOIN (SELECT score, count(*) AS nr FROM (SELECT ref, max(score) AS score FROM hits GROUP BY 1) GROUP BY 1) USING (score) GROUP BY 1)"""
CURVE = f"--ctes {DENSITY.format('preds')}, {STEPS}, {_curve_sql('st', str(M._accumulated()))}"


def _scored_preds(spark, sf):
    return cut(scored_sets(spark, sf, V.preds(spark, sf)))


@query("net ov", f"{CURVE} SELECT threshold, n_preds::BIGINT AS n_preds, round(precision, 6) AS precision, round(recall, 6) AS recall FROM points")
def pr_curve(spark, sf):
    return only(M.pr_curve(_scored_preds(spark, sf), V.preds(spark, sf), V.refs(spark, sf)), "threshold", "n_preds", "precision", "recall")


@query("net ov", f"{CURVE} SELECT round(sum((recall - pr) * precision), 6) AS auc FROM (SELECT *, coalesce(lag(recall) OVER (ORDER BY threshold DESC), 0) AS pr FROM points)")
def auc_pr(spark, sf):
    return rounded(M.auc_pr(_scored_preds(spark, sf), V.preds(spark, sf), V.refs(spark, sf)), "auc")


@query("ov refs", "SELECT round(sum(m) / (SELECT count(*) FROM refs)::DOUBLE, 6) AS sensitivity FROM (SELECT max(both_n) AS m FROM ov GROUP BY b)")
def sensitivity(spark, sf):
    return rounded(M.sensitivity(V.preds(spark, sf), V.refs(spark, sf)), "sensitivity")


@query("ov", "SELECT round(sum(m) / sum(s)::DOUBLE, 6) AS ppv FROM (SELECT max(both_n) AS m, sum(both_n) AS s FROM ov GROUP BY a)")
def predictive_value(spark, sf):
    return rounded(M.predictive_value(V.preds(spark, sf), V.refs(spark, sf)), "ppv")


@query("ov refs", """--ctes x AS (SELECT (SELECT sum(m) FROM (SELECT max(both_n) AS m FROM ov GROUP BY b)) / (SELECT count(*) FROM refs)::DOUBLE AS s,
    (SELECT sum(m) / sum(t)::DOUBLE FROM (SELECT max(both_n) AS m, sum(both_n) AS t FROM ov GROUP BY a)) AS p)
    SELECT round(s, 6) AS sensitivity, round(p, 6) AS ppv, round(sqrt(s * p), 6) AS accuracy FROM x""")  # fmt: skip
def accuracy(spark, sf):
    return only(M.accuracy(V.preds(spark, sf), V.refs(spark, sf)), "sensitivity", "ppv", "accuracy")


@query("ov refs", "SELECT round(count(DISTINCT b) / (SELECT count(DISTINCT cid) FROM refs)::DOUBLE, 6) AS fraction_matched FROM ov WHERE both_n * both_n / (na * nb)::DOUBLE > 0.25")
def fraction_matched(spark, sf):
    return rounded(M.fraction_matched(V.preds(spark, sf), V.refs(spark, sf)), "fraction_matched")


@query("ov preds refs", """SELECT round(sqrt(sum(x) / (SELECT count(DISTINCT cid) FROM refs) * (sum(x) / (SELECT count(DISTINCT cid) FROM preds))), 6) AS separation FROM (
    SELECT both_n * both_n / (sum(both_n) OVER (PARTITION BY b) * sum(both_n) OVER (PARTITION BY a))::DOUBLE AS x FROM ov)""")  # fmt: skip
def separation(spark, sf):
    return rounded(M.separation(V.preds(spark, sf), V.refs(spark, sf)), "separation")


# a predicted set lies inside one reference here, so the best matching gives each reference its best prediction
@query("ov refs", """SELECT round(sum(w), 6) AS total, (SELECT count(DISTINCT cid) FROM refs) AS n_refs, round(sum(w) / (SELECT count(DISTINCT cid) FROM refs), 6) AS ratio
    FROM (SELECT b, max(both_n * both_n / (na * nb)::DOUBLE) AS w FROM ov WHERE both_n * both_n / (na * nb)::DOUBLE > 0.2 GROUP BY 1)""")  # fmt: skip
def matching_ratio(spark, sf):
    return only(P.matching_ratio(V.preds(spark, sf), V.refs(spark, sf)), "total", "n_refs", "ratio")




XVAL = f"""{DENSITY.format('preds')}, m AS (SELECT a AS cid, b AS ref FROM ov WHERE ({AWARE}) >= 0.5), turns AS (SELECT DISTINCT iteration FROM xval),
    hits AS (SELECT x.iteration, m.cid, m.ref, score FROM m JOIN xval x ON x.cid = m.ref JOIN dens_preds p ON p.cid = m.cid),
    judged AS (SELECT t.iteration, p.cid, p.score, (t.iteration, p.cid) IN (SELECT (iteration, cid) FROM hits) AS ok FROM dens_preds p, turns t
        WHERE (t.iteration, p.cid) IN (SELECT (iteration, cid) FROM hits) OR p.cid NOT IN (SELECT cid FROM m)),
    st AS (SELECT j.iteration, j.score, count(*) AS np, count(*) FILTER (ok) AS nc, coalesce(any_value(nr), 0) AS nr FROM judged j
        LEFT JOIN (SELECT iteration, score, count(*) AS nr FROM (SELECT iteration, ref, max(score) AS score FROM hits GROUP BY 1, 2) GROUP BY 1, 2) f USING (iteration, score) GROUP BY 1, 2)"""


@query("net ov xval", f"""--ctes {XVAL} SELECT iteration, score AS threshold, (sum(np) OVER o)::BIGINT AS n_preds, round(sum(nc) OVER o / (sum(np) OVER o)::DOUBLE, 6) AS precision,
    round(sum(nr) OVER o / (SELECT count(*) FROM xval x WHERE x.iteration = st.iteration)::DOUBLE, 6) AS recall FROM st WINDOW o AS (PARTITION BY iteration ORDER BY score DESC ROWS UNBOUNDED PRECEDING)""")  # fmt: skip
def xval_curves(spark, sf):
    return only(M.cross_validated(_scored_preds(spark, sf), V.preds(spark, sf), V.refs(spark, sf), V.xval(spark, sf)), "iteration", "threshold", "n_preds", "precision", "recall")


@query("net ov xval", f"""--ctes {XVAL}, su AS (SELECT score, sum(np) AS np, sum(nc) AS nc, sum(nr) AS nr FROM st GROUP BY 1)
    SELECT score AS threshold, (sum(np) OVER o)::BIGINT AS n_preds, round(sum(nc) OVER o / (sum(np) OVER o)::DOUBLE, 6) AS precision,
    round(sum(nr) OVER o / (SELECT count(*) FROM xval)::DOUBLE, 6) AS recall FROM su WINDOW o AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)""")  # fmt: skip
def xval_pooled_curve(spark, sf):
    return only(M.pooled_cross_validated(_scored_preds(spark, sf), V.preds(spark, sf), V.refs(spark, sf), V.xval(spark, sf)), "threshold", "n_preds", "precision", "recall")


@query("ov rsize", f"""--ctes hit AS (SELECT DISTINCT b AS cid FROM ov WHERE ({AWARE}) >= 0.5)
    SELECT cid, 1::BIGINT AS n_tested, (cid IN (FROM hit))::BIGINT AS n_matched, (cid IN (FROM hit))::INT::DOUBLE AS rate FROM rsize""")  # fmt: skip
def xval_match_rate(spark, sf):
    return M.reference_match_rate(V.preds(spark, sf), V.refs(spark, sf), V.xval(spark, sf))


@query("net preds", f"""--ctes {DENSITY.format('preds')} SELECT split_part(cid, '/', 1) AS brand, count(*) AS n, round(avg(score), 6) AS mean,
    round(stddev_samp(score) / sqrt(count(*)), 6) AS error FROM dens_preds GROUP BY 1""")  # fmt: skip
def mean_and_error(spark, sf):
    rows = scored_sets(spark, sf, V.preds(spark, sf)).select(F.split("cid", "/")[0].alias("brand"), "score")
    return only(M.mean_and_error(rows, "score", ["brand"]), "brand", "n", "mean", "error")


@query("net refs", """--ctes lab AS (SELECT net.*, EXISTS (SELECT 1 FROM refs a JOIN refs b ON a.cid = b.cid WHERE a.node = u AND b.node = v) AS pos FROM net),
    st AS (SELECT w AS score, count(*) AS n, count(*) FILTER (pos) AS tp FROM lab GROUP BY 1),
    run AS (SELECT score, sum(tp) OVER o / (SELECT sum(tp) FROM st)::DOUBLE AS r, sum(tp) OVER o / (sum(n) OVER o)::DOUBLE AS p, sum(n - tp) OVER o / (SELECT sum(n - tp) FROM st)::DOUBLE AS f FROM st
        WINDOW o AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
    d AS (SELECT *, coalesce(lag(r) OVER (ORDER BY score DESC), 0) AS r0, coalesce(lag(f) OVER (ORDER BY score DESC), 0) AS f0 FROM run)
    SELECT round(sum((r - r0) * p), 6) AS auc_pr, round(sum((f - f0) * (r + r0) / 2), 6) AS auc_roc FROM d""")  # fmt: skip
def edge_pr_roc(spark, sf):
    edges = cut(V.net(spark, sf))
    labelled = E.label_edges(edges.select("u", "v"), V.refs(spark, sf)).join(edges, ["u", "v"])
    return only(M.edge_curve(labelled.select(F.col("w").alias("score"), (F.col("cls") == 1).alias("positive"))), "auc_pr", "auc_roc")


@query("net preds", f"--ctes {DENSITY.format('preds')} SELECT split_part(cid, '/', 3) AS cls, round(avg(size), 6) AS size, round(avg(score), 6) AS score FROM dens_preds GROUP BY 1")
def metrics_roll_up(spark, sf):
    rows = C.weighted_density(V.preds(spark, sf), V.net(spark, sf)).select(F.split("cid", "/")[2].alias("cls"), "size", F.round("score", 4).alias("score"))
    return only(M.roll_up(rows, ["cls"]), "cls", "size", "score")


# ---------------------------------------------------------------- supervised scores, small sets, ontology


def _labelled(spark, sf):
    """Kept pairs, positive where they also share a predicted set: classes 0 and 1."""
    ev = cut(V.evidence(spark, sf))
    pairs = ev.select("u", "v").distinct()
    return ev, cut(E.label_edges(pairs, V.preds(spark, sf)))


LABELS = "lab AS (SELECT u, v, EXISTS (SELECT 1 FROM preds a JOIN preds b ON a.cid = b.cid WHERE a.node = u AND b.node = v)::INT AS cls FROM kept)"
BINNED = f"""{LABELS}, cuts AS (SELECT * FROM (VALUES ('ORDERS', [1.5]), ('SUPP', [1.5, 2.5]), ('SIZE', [10.0, 24.5])) t(subtype, cuts)),
    binned AS (SELECT u, v, subtype, len(list_filter(cuts, lambda x: x < score)) AS bin FROM evidence JOIN cuts USING (subtype)),
    tot AS (SELECT cls, count(*) AS total FROM lab GROUP BY 1), cells AS (SELECT DISTINCT subtype, bin FROM binned), nb AS (SELECT subtype, count(*) AS bins FROM cells GROUP BY 1),
    lik AS (SELECT c.subtype, c.bin, tot.cls, (coalesce(n, 0) + 1) / (total + bins)::DOUBLE AS likelihood FROM cells c CROSS JOIN tot JOIN nb USING (subtype)
        LEFT JOIN (SELECT subtype, bin, cls, count(*) AS n FROM binned JOIN lab USING (u, v) GROUP BY 1, 2, 3) k ON k.subtype = c.subtype AND k.bin = c.bin AND k.cls = tot.cls)"""


def _fixed_cuts(spark):
    return spark.createDataFrame([("ORDERS", [1.5]), ("SUPP", [1.5, 2.5]), ("SIZE", [10.0, 24.5])], "subtype string, cuts array<double>")


@query("evidence preds", f"--ctes {BINNED} SELECT subtype, bin::INT AS bin, cls, round(likelihood, 6) AS likelihood FROM lik")
def likelihood_table(spark, sf):
    ev, labels = _labelled(spark, sf)
    return rounded(E.likelihoods(E.apply_cuts(ev, _fixed_cuts(spark)), labels), "likelihood")


@query("evidence preds", f"""--ctes {BINNED}, pr AS (SELECT cls, total / (sum(total) OVER ())::DOUBLE AS prior FROM tot),
    x AS (SELECT u, v, cls, product(likelihood) * any_value(prior) AS x FROM binned JOIN lik USING (subtype, bin) JOIN pr USING (cls) GROUP BY 1, 2, 3)
    SELECT u, v, cls, round(x / sum(x) OVER (PARTITION BY u, v), 6) AS p FROM x""")  # fmt: skip
def posterior_scores(spark, sf):
    ev, labels = _labelled(spark, sf)
    binned = cut(E.apply_cuts(ev, _fixed_cuts(spark)))
    return rounded(E.posteriors(binned, E.likelihoods(binned, labels), E.class_priors(labels)), "p")


@query("evidence preds", f"""--ctes {BINNED}, pr AS (SELECT cls, total / (sum(total) OVER ())::DOUBLE AS prior FROM tot),
    x AS (SELECT u, v, cls, product(likelihood) * any_value(prior) AS x FROM binned JOIN lik USING (subtype, bin) JOIN pr USING (cls) GROUP BY 1, 2, 3)
    SELECT u, v, round(max(CASE WHEN cls = 1 THEN x END) / max(CASE WHEN cls = 0 THEN x END), 6) AS w FROM x GROUP BY 1, 2""")  # fmt: skip
def posterior_ratios(spark, sf):
    ev, labels = _labelled(spark, sf)
    binned = cut(E.apply_cuts(ev, _fixed_cuts(spark)))
    return rounded(E.posterior_ratio(binned, E.likelihoods(binned, labels), E.class_priors(labels)), "w")


@query("evidence preds", f"""--ctes {BINNED}, k AS (SELECT subtype, bin, cls, count(*) AS n FROM binned JOIN lab USING (u, v) GROUP BY 1, 2, 3),
    g AS (SELECT c.subtype, c.bin, tot.cls, total, bins, sum(coalesce(n, 0)) OVER (PARTITION BY c.subtype, tot.cls ORDER BY c.bin DESC) AS n
          FROM cells c CROSS JOIN tot JOIN nb USING (subtype) LEFT JOIN k ON k.subtype = c.subtype AND k.bin = c.bin AND k.cls = tot.cls)
    SELECT subtype, bin::INT AS bin, cls, round((n + 1) / (total + bins)::DOUBLE, 6) AS likelihood FROM g""")  # fmt: skip
def cumulative_likelihoods(spark, sf):
    ev, labels = _labelled(spark, sf)
    return rounded(E.likelihoods(E.apply_cuts(ev, _fixed_cuts(spark)), labels, cumulative=True), "likelihood")


@query("evidence preds", f"""--ctes {BINNED}, k AS (SELECT subtype, bin, cls, count(*) AS n FROM binned JOIN lab USING (u, v) GROUP BY 1, 2, 3)
    SELECT c.subtype, c.bin::INT AS bin, tot.cls, round((coalesce(n, 0) + 1) / (total + (SELECT sum(bins) FROM nb))::DOUBLE, 6) AS likelihood
    FROM cells c CROSS JOIN tot LEFT JOIN k ON k.subtype = c.subtype AND k.bin = c.bin AND k.cls = tot.cls""")  # fmt: skip
def shared_likelihoods(spark, sf):
    ev, labels = _labelled(spark, sf)
    return rounded(E.likelihoods(E.apply_cuts(ev, _fixed_cuts(spark)), labels, shared_totals=True), "likelihood")


@query("evidence preds", f"--ctes {BINNED} SELECT u, v, round(product(CASE WHEN cls = 1 THEN likelihood ELSE 1 / likelihood END), 6) AS w FROM binned JOIN lik USING (subtype, bin) GROUP BY 1, 2")
def likelihood_ratio(spark, sf):
    ev, labels = _labelled(spark, sf)
    binned = cut(E.apply_cuts(ev, _fixed_cuts(spark)))
    return rounded(E.likelihood_ratio(binned, E.likelihoods(binned, labels)), "w")


@query("evidence", "SELECT u, v, round(1 - product(1 - score / 100), 6) AS w FROM evidence GROUP BY 1, 2")
def joined_probability(spark, sf):
    return rounded(E.string_score(V.evidence(spark, sf).withColumn("score", F.col("score") / 100)), "w")


@query("evidence preds", f"""--ctes {LABELS}, tot AS (SELECT cls, count(*) AS total FROM lab GROUP BY 1), h AS (SELECT subtype, score AS value, cls, count(*) AS n FROM evidence JOIN lab USING (u, v) GROUP BY 1, 2, 3),
    z AS (SELECT s.subtype, 0.0::DOUBLE AS value, tot.cls, total - coalesce(k, 0) AS n FROM (SELECT DISTINCT subtype FROM h) s CROSS JOIN tot LEFT JOIN (SELECT subtype, cls, sum(n) AS k FROM h GROUP BY 1, 2) p ON p.subtype = s.subtype AND p.cls = tot.cls)
    SELECT subtype, value, cls, sum(n)::BIGINT AS n FROM (FROM h UNION ALL FROM z WHERE n > 0) GROUP BY 1, 2, 3""")  # fmt: skip
def evidence_histogram(spark, sf):
    ev, labels = _labelled(spark, sf)
    return E.histogram(ev, labels, implicit_zeros=True)


@query()
def mdl_cutpoints(spark, sf):
    ev, labels = _labelled(spark, sf)
    return E.cut_points(E.histogram(ev, labels)).select("subtype", F.array_join(F.transform("cuts", lambda x: x.cast("string")), " ").alias("cuts"))


# neighbouring bins pooled: the ratios of the result are the greatest convex minorant's slopes, max over beginnings of min over ends of pooled ratios
@query("evidence preds", f"""--ctes {BINNED}, ab AS (SELECT subtype, bin, max(CASE WHEN cls = 1 THEN likelihood END) AS a, max(CASE WHEN cls = 0 THEN likelihood END) AS b FROM lik GROUP BY 1, 2),
    blocks AS (SELECT x.subtype, x.bin AS lo, y.bin AS hi, sum(z.a) / sum(z.b) AS ratio FROM ab x JOIN ab y ON x.subtype = y.subtype AND x.bin <= y.bin JOIN ab z ON z.subtype = x.subtype AND z.bin BETWEEN x.bin AND y.bin GROUP BY 1, 2, 3),
    slope AS (SELECT subtype, bin, max(least_ratio) AS ratio FROM (SELECT b.subtype, b.bin, lo, min(k.ratio) AS least_ratio FROM ab b JOIN blocks k ON k.subtype = b.subtype AND b.bin BETWEEN lo AND hi GROUP BY 1, 2, 3) GROUP BY 1, 2),
    pool AS (SELECT ab.*, round(ratio, 9) AS r FROM ab JOIN slope USING (subtype, bin)), m AS (SELECT subtype, r, avg(a) AS a, avg(b) AS b FROM pool GROUP BY 1, 2),
    out AS (SELECT pool.subtype, bin, m.a, m.b FROM pool JOIN m USING (subtype, r))
    SELECT subtype, bin::INT AS bin, 1 AS cls, round(a, 6) AS likelihood FROM out UNION ALL SELECT subtype, bin::INT, 0, round(b, 6) FROM out""")  # fmt: skip
def smoothed_likelihoods(spark, sf):
    ev, labels = _labelled(spark, sf)
    return rounded(E.smooth(E.likelihoods(E.apply_cuts(ev, _fixed_cuts(spark)), labels)), "likelihood")


@query()
def selected_features(spark, sf):
    ev, labels = _labelled(spark, sf)
    return spark.createDataFrame([(x,) for x in E.select_features(ev, labels)], "subtype string")


@query()
def iso_em_scores(spark, sf):
    ev = cut(V.evidence(spark, sf))
    labels = cut(E.label_sizes(ev.select("u", "v").distinct(), V.preds(spark, sf)))
    return rounded(E.iso_em(ev, labels), "s0", "s2", "s4")


@query("scores", f"""--ctes adj AS (SELECT u AS src, v AS dst, least(s2 + s4, 0.9999) AS s FROM scores UNION ALL SELECT v, u, least(s2 + s4, 0.9999) FROM scores), e AS (SELECT u, v, s2 AS w FROM scores),
    {TRI.format('e')}, lg AS (SELECT src AS node, sum(ln(1 - s)) AS l FROM adj GROUP BY 1), one AS (SELECT u, v, ln(1 - least(s2 + s4, 0.9999)) AS l FROM scores),
    t AS (SELECT a, b, c, wab * wac * wbc * exp(la.l + lb.l + lc.l - 2 * (x.l + y.l + z.l)) AS s FROM tri JOIN lg la ON la.node = a JOIN lg lb ON lb.node = b JOIN lg lc ON lc.node = c
        JOIN one x ON x.u = a AND x.v = b JOIN one y ON y.u = a AND y.v = c JOIN one z ON z.u = b AND z.v = c),
    g AS (SELECT u, v, sum(s) AS s FROM (SELECT a AS u, b AS v, s FROM t UNION ALL SELECT a, c, s FROM t UNION ALL SELECT b, c, s FROM t) GROUP BY 1, 2)
    SELECT u, v, round(s2 * exp(a.l + b.l - 2 * one.l) + coalesce(g.s, 0), 6) AS iso FROM scores JOIN one USING (u, v) JOIN lg a ON a.node = u JOIN lg b ON b.node = v LEFT JOIN g USING (u, v)""")  # fmt: skip
def isolatedness(spark, sf):
    return rounded(E.isolatedness(cut(V.scores(spark, sf))), "iso")


@query("kept refs", """--ctes t AS (SELECT range AS iteration FROM range(3)), x AS (SELECT cid, length(cid) % 3 AS iteration FROM (SELECT DISTINCT cid FROM refs))
    SELECT t.iteration::INT AS iteration, u, v, EXISTS (SELECT 1 FROM refs a JOIN refs b ON a.cid = b.cid JOIN x ON x.cid = a.cid WHERE a.node = u AND b.node = v AND x.iteration <> t.iteration)::INT AS cls FROM kept, t""")  # fmt: skip
def training_labels(spark, sf):
    refs = V.refs(spark, sf)
    turns = refs.select("cid").distinct().select((F.length("cid") % 3).cast("int").alias("iteration"), "cid")
    return E.training_labels(cut(V.kept(spark, sf)), refs, turns)


SMALL = "e AS (SELECT u, v, s2 AS w FROM scores), adj AS (SELECT u AS src, v AS dst, w FROM e UNION ALL SELECT v, u, w FROM e), s AS (SELECT src AS node, sum(w) AS s FROM adj GROUP BY 1)"


@query("scores", f"""--ctes {SMALL}, l AS (SELECT u, v, sum(p.w * q.w) AS l FROM e JOIN adj p ON p.src = u JOIN adj q ON q.src = v AND q.dst = p.dst GROUP BY 1, 2),
    x AS (SELECT u, v, greatest(0, e.w * (1 - coalesce(l, 0))) AS n, a.s + b.s - 2 * e.w AS ext FROM e LEFT JOIN l USING (u, v) JOIN s a ON a.node = u JOIN s b ON b.node = v)
    SELECT u, v, round(n / (n + greatest(ext, 0)) * n, 6) AS score FROM x WHERE n > 0 AND n / (n + greatest(ext, 0)) * n >= 1e-8""")  # fmt: skip
def small_sets_of_two(spark, sf):
    scored = cut(V.scores(spark, sf).select("u", "v", F.col("s2").alias("w")))
    return rounded(S.pairs_of_two(scored), "score")


@query("scores", f"""--ctes {SMALL}, {TRI.format('e')}, l AS (SELECT u, v, sum(p.w * q.w) AS l FROM e JOIN adj p ON p.src = u JOIN adj q ON q.src = v AND q.dst = p.dst GROUP BY 1, 2),
    x AS (SELECT a, b, c, greatest(0, wab * (1 - x.l + wac * wbc)) + greatest(0, wac * (1 - y.l + wab * wbc)) + greatest(0, wbc * (1 - z.l + wab * wac)) AS n,
        greatest(0, sa.s + sb.s + sc.s - 2 * (wab + wac + wbc)) AS ext FROM tri JOIN l x ON x.u = a AND x.v = b JOIN l y ON y.u = a AND y.v = c JOIN l z ON z.u = b AND z.v = c
        JOIN s sa ON sa.node = a JOIN s sb ON sb.node = b JOIN s sc ON sc.node = c)
    SELECT a, b, c, round(n / (n + ext) * (n / 3), 6) AS score FROM x WHERE n > 0 AND n / (n + ext) * (n / 3) >= 1e-8""")  # fmt: skip
def small_sets_of_three(spark, sf):
    scored = cut(V.scores(spark, sf).select("u", "v", F.col("s2").alias("w")))
    return rounded(S.sets_of_three(scored), "score")


def _annots(spark, sf):
    links = cut(V.term_links(spark, sf))
    return links, cut(O.propagate(V.direct_annots(spark, sf), links))


TERMS = """cnt AS (SELECT term, count(DISTINCT node) AS n FROM annots GROUP BY 1), anc AS (SELECT child AS term, parent AS ancestor FROM links UNION SELECT a.child, b.parent FROM links a JOIN links b ON a.parent = b.child),
    lim AS (SELECT max(n) / 20 AS least FROM cnt), big AS (SELECT cnt.* FROM cnt, lim WHERE n >= least),
    ch AS (SELECT * FROM big WHERE term NOT IN (SELECT parent FROM links JOIN big ON big.term = child)),
    terms AS (SELECT * FROM ch WHERE term NOT IN (SELECT anc.term FROM anc JOIN ch c ON c.term = ancestor))"""


def _terms(spark, sf):
    links, annots = _annots(spark, sf)
    least = annots.groupBy("term").agg(F.countDistinct("node").alias("n")).agg(F.max("n")).first()[0] / 20
    return links, annots, cut(O.informative_terms(annots, links, least))


@query("links annots", f"--ctes {TERMS} SELECT term, n FROM terms")
def informative_terms(spark, sf):
    return _terms(spark, sf)[2].select("term", "n")


@query("links annots supp_net", f"--ctes {TERMS} SELECT a.term, s.* FROM supp_net s JOIN annots a ON a.node = u JOIN annots b ON b.node = v AND b.term = a.term WHERE a.term IN (SELECT term FROM terms)")
def term_subnetworks(spark, sf):
    _, annots, terms = _terms(spark, sf)
    return O.subnetworks(V.supp_net(spark, sf), annots, terms)


@query("links annots supp_net", f"""--ctes {TERMS}, spec AS (SELECT * FROM annots a WHERE NOT EXISTS (SELECT 1 FROM annots b JOIN links ON child = b.term WHERE b.node = a.node AND parent = a.term)),
    sh AS (SELECT anc.term, ancestor, c.n / d.n::DOUBLE AS p FROM anc JOIN terms USING (term) JOIN cnt c ON c.term = anc.term JOIN cnt d ON d.term = ancestor),
    mem AS (SELECT node, term, max(p) AS p FROM (SELECT node, sh.term, p FROM spec JOIN sh ON ancestor = spec.term UNION ALL SELECT node, term, 1.0 FROM annots WHERE term IN (SELECT term FROM terms)) GROUP BY 1, 2),
    best AS (SELECT u, v, max(least(a.p, b.p)) AS p FROM supp_net JOIN mem a ON a.node = u JOIN mem b ON b.node = v AND b.term = a.term GROUP BY 1, 2)
    SELECT u, v, round(coalesce(p, 0), 6) AS p FROM supp_net LEFT JOIN best USING (u, v) WHERE coalesce(p, 0) < 1""")  # fmt: skip
def incompatible_edges(spark, sf):
    links, annots, terms = _terms(spark, sf)
    return rounded(O.incompatible_edges(V.supp_net(spark, sf), annots, links, terms), "p")


@query("net2 neg", """--ctes s AS (SELECT u || '+' || v AS cid, u, v, w FROM net2), b AS (SELECT u, v, 0.25::DOUBLE AS p FROM neg) SELECT cid, round(w * coalesce(p, 1), 6) AS score FROM s LEFT JOIN b USING (u, v)""")
def down_weighted_sets(spark, sf):
    edges = cut(V.net2(spark, sf))
    cid = F.concat_ws("+", "u", "v").alias("cid")
    sets = edges.select(cid, F.explode(F.array("u", "v")).alias("node"))
    bad = V.neg(spark, sf).withColumn("p", F.lit(0.25))
    return rounded(O.down_weight(edges.select(cid, F.col("w").alias("score")), sets, bad), "score")


TRIPLES = f"""{TRI.format('net2')}, s AS (SELECT a || '+' || b || '+' || c AS cid, a, b, c, wab + wac + wbc AS w FROM tri),
    bad AS (SELECT cid, count(*) AS k FROM s JOIN neg ON (u = a AND v IN (b, c)) OR (u = b AND v = c) GROUP BY 1)"""


def _triples(spark, sf, delete):
    t = cut(G.triangles(V.net2(spark, sf)).withColumn("cid", F.concat_ws("+", "a", "b", "c")))
    bad = V.neg(spark, sf).withColumn("p", F.lit(0.25))
    scored = t.select("cid", (F.col("wab") + F.col("wac") + F.col("wbc")).alias("score"))
    return rounded(O.down_weight(scored, t.select("cid", F.explode(F.array("a", "b", "c")).alias("node")), bad, delete), "score")


@query("net2 neg", f"--ctes {TRIPLES} SELECT cid, round(w * 0.75 ** coalesce(k, 0), 6) AS score FROM s LEFT JOIN bad USING (cid)")
def down_weighted_triples(spark, sf):
    return _triples(spark, sf, False)


@query("net2 neg", f"--ctes {TRIPLES} SELECT cid, round(w, 6) AS score FROM s WHERE cid NOT IN (SELECT cid FROM bad)")
def triples_without_bad_edges(spark, sf):
    return _triples(spark, sf, True)


# ---------------------------------------------------------------- pipelines


@query()
def pipeline_ensemble(spark, sf):
    return pipelines.ensemble(V.net(spark, sf), V.refs(spark, sf), V.neg(spark, sf), "parts", "brands")


@query()
def pipeline_single(spark, sf):
    return reduce(DataFrame.unionByName, [pipelines.single(V.net(spark, sf), V.refs(spark, sf), m, "parts", "brands") for m in pipelines.METHODS])


@query()
def pipeline_integrated(spark, sf):
    links = cut(V.part_links(spark, sf))
    annots = cut(O.propagate(V.part_annots(spark, sf), links))
    least = annots.groupBy("term").agg(F.countDistinct("node").alias("n")).agg(F.max("n")).first()[0] / 20
    terms = cut(O.informative_terms(annots, links, least))
    return pipelines.integrated(V.evidence(spark, sf), V.preds(spark, sf), (links, annots, terms))
