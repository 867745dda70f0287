"""Networks and sets derived from the shared test tables, in Spark; SQL holds the same views for the oracle.

Nodes are parts: `net` joins parts of one order (weight: orders that have both), `kept` is what of it stays inside reference sets,
`refs` are parts by brand and type, `preds` by brand, type and size class. Suppliers carry the ontology: nation, region, root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsets.plans.lineage import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o, node: the different parts of each order."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").cast("string").alias("node")).distinct()


def net(spark: SparkSession, sf_dir: str, kind: str = "string") -> DataFrame:
    """Parts bought together. An order's parts are gathered once and paired inside it: one exchange of rows, none of pairs before
    they are counted. An order has few parts. kind="bigint" keeps the parts' numbers, u < v by number: pairs then take half the bytes."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").cast(kind).alias("node"))
    listed = rows.groupBy("o").agg(F.sort_array(F.collect_set("node")).alias("p")).where(F.size("p") > 1)
    first = listed.select("p", F.posexplode("p").alias("i", "u"))
    pairs = first.select("u", F.explode(F.slice("p", F.col("i") + 2, F.size("p"))).alias("v"))
    return pairs.groupBy("u", "v").agg(F.count(F.lit(1)).cast("double").alias("w"))


def net2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return net(spark, sf_dir).where("w >= 2")


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.concat_ws("/", "p_brand", "p_type").alias("cid"), F.col("p_partkey").cast("string").alias("node"))


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    size = F.when(F.col("p_size") <= 25, "low").otherwise("high")
    return p.select(F.concat_ws("/", "p_brand", "p_type", size).alias("cid"), F.col("p_partkey").cast("string").alias("node"))


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netsets.operators.filters import keep_pairs

    return keep_pairs(net(spark, sf_dir), refs(spark, sf_dir))


def neg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts both returned in one order."""
    r = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").cast("string").alias("node")).distinct()
    a, b = r.select("o", F.col("node").alias("u")), r.select("o", F.col("node").alias("v"))
    return a.join(b, "o").where("u < v").select("u", "v").distinct()


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u, v, subtype, score for kept pairs: ORDERS (weight), SUPP (shared suppliers, where there are any), SIZE (size difference)."""
    pairs = cut(kept(spark, sf_dir))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("node"), "p_size")
    s = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("node"), "l_suppkey").distinct()
    su, sv = s.select(F.col("node").alias("u"), "l_suppkey"), s.select(F.col("node").alias("v"), "l_suppkey")
    supp = pairs.join(su, "u").join(sv, ["v", "l_suppkey"]).groupBy("u", "v").agg(F.count(F.lit(1)).cast("double").alias("score"))
    size = pairs.join(p.select(F.col("node").alias("u"), F.col("p_size").alias("a")), "u").join(p.select(F.col("node").alias("v"), F.col("p_size").alias("b")), "v")
    rows = pairs.select("u", "v", F.lit("ORDERS").alias("subtype"), F.col("w").alias("score"))
    rows = rows.unionByName(supp.select("u", "v", F.lit("SUPP").alias("subtype"), "score"))
    return rows.unionByName(size.select("u", "v", F.lit("SIZE").alias("subtype"), F.abs(F.col("a") - F.col("b")).cast("double").alias("score")))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u, v, s2, s4: edge scores in elevenths for the small-set methods, from the weights of net2: no result then ends on a decimal tie."""
    return net2(spark, sf_dir).select("u", "v", (F.least(F.col("w"), F.lit(8.0)) / 11).alias("s2"), F.lit(0.1).alias("s4"))


def supp_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that share a part."""
    s = table(spark, sf_dir, "lineitem").select("l_partkey", F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("node")).distinct()
    a, b = s.select("l_partkey", F.col("node").alias("u")), s.select("l_partkey", F.col("node").alias("v"))
    return a.join(b, "l_partkey").where("u < v").groupBy("u", "v").agg(F.count(F.lit(1)).cast("double").alias("w"))


def term_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    up = n.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("child"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("parent"))
    return up.unionByName(r.select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("child"), F.lit("root").alias("parent")))


def direct_annots(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("node"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("term"))


def part_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ontology of parts: brands below groups of brands below one root."""
    brand = table(spark, sf_dir, "part").select("p_brand").distinct()
    group = F.substring("p_brand", 1, 7)
    return brand.select(F.col("p_brand").alias("child"), group.alias("parent")).unionByName(brand.select(group.alias("child"), F.lit("root").alias("parent")).distinct())


def part_annots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("node"), F.col("p_brand").alias("term"))


def xval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """iteration, cid: each reference set is tested in one of ten iterations."""
    cids = refs(spark, sf_dir).select("cid").distinct()
    return cids.select((F.conv(F.substring(F.md5("cid"), 1, 4), 16, 10).cast("int") % 10).alias("iteration"), "cid")


SQL = {
    "basket": "SELECT DISTINCT l_orderkey AS o, CAST(l_partkey AS VARCHAR) AS node FROM lineitem",
    "net": "SELECT a.node AS u, b.node AS v, count(*)::DOUBLE AS w FROM basket a JOIN basket b ON a.o = b.o AND a.node < b.node GROUP BY 1, 2",
    "net2": "SELECT * FROM net WHERE w >= 2",
    "refs": "SELECT p_brand || '/' || p_type AS cid, CAST(p_partkey AS VARCHAR) AS node FROM part",
    "preds": "SELECT p_brand || '/' || p_type || '/' || CASE WHEN p_size <= 25 THEN 'low' ELSE 'high' END AS cid, CAST(p_partkey AS VARCHAR) AS node FROM part",
    "kept": "SELECT DISTINCT net.* FROM net JOIN refs a ON a.node = u JOIN refs b ON b.node = v AND a.cid = b.cid",
    "neg": """SELECT DISTINCT CAST(a.l_partkey AS VARCHAR) AS u, CAST(b.l_partkey AS VARCHAR) AS v FROM lineitem a JOIN lineitem b USING (l_orderkey)
        WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'R' AND CAST(a.l_partkey AS VARCHAR) < CAST(b.l_partkey AS VARCHAR)""",
    "psupp": "SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS node, l_suppkey FROM lineitem",
    "evidence": """SELECT u, v, 'ORDERS' AS subtype, w AS score FROM kept
        UNION ALL SELECT u, v, 'SUPP', count(*)::DOUBLE FROM kept JOIN psupp a ON a.node = u JOIN psupp b ON b.node = v AND a.l_suppkey = b.l_suppkey GROUP BY u, v
        UNION ALL SELECT u, v, 'SIZE', abs(a.p_size - b.p_size)::DOUBLE FROM kept JOIN part a ON CAST(a.p_partkey AS VARCHAR) = u JOIN part b ON CAST(b.p_partkey AS VARCHAR) = v""",
    "scores": "SELECT u, v, least(w, 8.0) / 11 AS s2, 0.1::DOUBLE AS s4 FROM net2",
    "ssupp": "SELECT DISTINCT l_partkey, 'S' || l_suppkey AS node FROM lineitem",
    "supp_net": "SELECT a.node AS u, b.node AS v, count(*)::DOUBLE AS w FROM ssupp a JOIN ssupp b ON a.l_partkey = b.l_partkey AND a.node < b.node GROUP BY 1, 2",
    "links": "SELECT 'N' || n_nationkey AS child, 'R' || n_regionkey AS parent FROM nation UNION ALL SELECT 'R' || r_regionkey, 'root' FROM region",
    "annots": """SELECT 'S' || s_suppkey AS node, 'N' || s_nationkey AS term FROM supplier
        UNION ALL SELECT 'S' || s_suppkey, 'R' || n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'S' || s_suppkey, 'root' FROM supplier""",
    "adj": "SELECT u AS src, v AS dst, w FROM {0} UNION ALL SELECT v, u, w FROM {0}",
    "deg": "SELECT src AS node, count(*) AS degree, sum(w) AS strength FROM {1} GROUP BY 1",
    "xval": "SELECT DISTINCT (('0x' || substr(md5(cid), 1, 4))::BIGINT % 10)::INT AS iteration, cid FROM refs",
    "psize": "SELECT cid, count(DISTINCT node) AS size FROM preds GROUP BY 1",
    "rsize": "SELECT cid, count(DISTINCT node) AS size FROM refs GROUP BY 1",
    "ov": """SELECT p.cid AS a, r.cid AS b, count(*) AS both_n, any_value(ps.size) AS na, any_value(rs.size) AS nb
        FROM preds p JOIN refs r USING (node) JOIN psize ps ON ps.cid = p.cid JOIN rsize rs ON rs.cid = r.cid GROUP BY 1, 2""",
}
#: What each view of SQL stands on.
NEEDS = {
    "net": ["basket"], "net2": ["net"], "kept": ["net", "refs"], "evidence": ["kept", "psupp"], "scores": ["net2"], "supp_net": ["ssupp"], "psize": ["preds"], "xval": ["refs"], "rsize": ["refs"],
    "ov": ["preds", "refs", "psize", "rsize"],
}


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """`WITH` the named views and what they stand on, then the body. `adj:net` and `deg:net` are adjacency and degrees of a view."""
    done: dict[str, str] = {}

    def need(name: str) -> None:
        if name in done:
            return
        if ":" in name:
            kind, of = name.split(":")
            need(of)
            if kind == "deg":
                need(f"adj:{of}")
            done[name] = f"{kind}_{of} AS ({SQL[kind].format(of, f'adj_{of}')})"
            return
        for other in NEEDS.get(name, []):
            need(other)
        done[name] = f"{name} AS ({SQL[name]})"

    for name in names.split():
        need(name)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(done.values()) + (",\n" if body.lstrip().startswith("--ctes") else "\n") + body.replace("--ctes", "", 1)
