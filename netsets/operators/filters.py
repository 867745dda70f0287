"""Denoising of networks by other networks and by sets; refs_x(cid, node) are exploded sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsets.plans.lineage import cut


def drop_listed(edges: DataFrame, listed: DataFrame) -> DataFrame:
    """Edges that are not in the negative list (u, v)."""
    return edges.join(listed.select("u", "v").distinct(), ["u", "v"], "left_anti")


#: Nodes of a set that are paired with as many others at once, and pairs that a task makes on average.
CHUNK_NODES, TASK_PAIRS = 1000, 4_000_000


def set_pairs(refs_x: DataFrame) -> DataFrame:
    """All pairs u < v that share a set, once. Grows with the square of a set, which is what the feature asks.

    Sets are cut into chunks in the order of nodes, and pairs of chunks dealt over the tasks. A pair with a node of one set alone arises
    once and is never sent on; only pairs of nodes that both are in several sets are told apart by an exchange."""
    rows = refs_x.select("cid", "node").where("cid is not null and node is not null").distinct()
    several = rows.groupBy("node").agg((F.count(F.lit(1)) > 1).alias("several"))
    place = F.row_number().over(Window.partitionBy("cid").orderBy("node"))
    placed = rows.join(several, "node").withColumn("chunk", F.floor((place - 1) / CHUNK_NODES))
    chunks = cut(placed.groupBy("cid", "chunk", "several").agg(F.collect_list("node").alias("us")))
    total = chunks.groupBy("cid").agg(F.sum(F.size("us")).cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n") / 2)).first()[0] or 0
    others = chunks.select("cid", F.col("chunk").alias("other"), F.col("several").alias("also"), F.col("us").alias("vs"))
    tasks = int(min(max(total / TASK_PAIRS, 1), 20_000))
    met = chunks.join(others, "cid").where("chunk <= other").repartition(tasks, "cid", "chunk", "other", "several", "also")

    def pairs(which: str) -> DataFrame:
        first = met.where(which).select("chunk", "other", "vs", F.explode("us").alias("u"))
        # generated code holds all rows of its input row: cut between the two steps, it holds a chunk, not the square of one
        each = first.coalesce(tasks).select("chunk", "other", "u", F.explode("vs").alias("v"))
        return each.where("chunk < other or u < v").select("u", "v")

    return pairs("not (several and also)").unionByName(pairs("several and also").distinct())


def keep_pairs(edges: DataFrame, refs_x: DataFrame, confidence: float = 0.0) -> DataFrame:
    """Edges whose ends share a set, at or above the confidence. Looks up the edges' own sets instead of making set pairs."""
    sets_u = refs_x.select(F.col("node").alias("u"), "cid")
    sets_v = refs_x.select(F.col("node").alias("v"), "cid")
    return edges.where(F.col("w") >= confidence).join(sets_u, "u").join(sets_v, ["v", "cid"], "left_semi").select("u", "v", "w").distinct()


def keep_members(edges: DataFrame, refs_x: DataFrame, confidence: float = 0.0, either: bool = False) -> DataFrame:
    """Edges with both ends (or either) in any set, at or above the confidence."""
    known = refs_x.select("node").distinct()
    strong = edges.where(F.col("w") >= confidence)
    ku, kv = known.withColumnRenamed("node", "u"), known.withColumnRenamed("node", "v")
    if not either:
        return strong.join(ku, "u", "left_semi").join(kv, "v", "left_semi").select("u", "v", "w")
    marked = strong.join(ku.withColumn("iu", F.lit(1)), "u", "left").join(kv.withColumn("iv", F.lit(1)), "v", "left")
    return marked.where("iu = 1 or iv = 1").select("u", "v", "w")


def keep_direct(edges: DataFrame, direct: DataFrame) -> DataFrame:
    """Edges of direct(u, v) with the network's weights; those that the network lacks are dropped."""
    return edges.join(direct.select("u", "v").distinct(), ["u", "v"]).select("u", "v", "w")


def overlapping_sets(refs_x: DataFrame) -> DataFrame:
    """Rows of the sets that share a member with another set."""
    shared = refs_x.groupBy("node").agg(F.countDistinct("cid").alias("n")).where("n > 1").select("node")
    touched = refs_x.join(shared, "node", "left_semi").select("cid").distinct()
    return refs_x.join(touched, "cid", "left_semi")


def shared_members(refs_x: DataFrame) -> DataFrame:
    """(i, j, node) for sets i < j that share the node."""
    a, b = refs_x.select(F.col("cid").alias("i"), "node"), refs_x.select(F.col("cid").alias("j"), "node")
    return a.join(b, "node").where("i < j").select("i", "j", "node")


def set_distribution(refs_x: DataFrame, small: int = 2) -> DataFrame:
    """kind (small, overlapping, regular) and the number of different sets of that kind."""
    keyed = refs_x.groupBy("cid").agg(F.array_join(F.sort_array(F.collect_set("node")), " ").alias("key"), F.countDistinct("node").alias("size"))
    one = keyed.groupBy("key").agg(F.min("cid").alias("cid"), F.first("size").alias("size"))
    members = refs_x.join(one.select("cid"), "cid", "left_semi")
    over = overlapping_sets(members).select("cid").distinct().withColumn("over", F.lit(1))
    kind = F.when(F.col("size") <= small, "small").when(F.col("over") == 1, "overlapping").otherwise("regular")
    return one.join(over, "cid", "left").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n_sets"))


def rescaled_top(edges: DataFrame, k: int, mode: str = "norm", cap: float = 100.0, low: float = 0.0, seed: int = 0) -> DataFrame:
    """The k heaviest edges (ties by id), rescaled: none; norm: capped, over the largest; scale: over the largest; stretch:
    from [min, max] to [low, max]; topall1: weight 1; noweight: k edges in an order drawn by the seed, weight 1."""
    every = Window.partitionBy()
    w = F.col("w")
    if mode == "noweight":
        return edges.orderBy(F.md5(F.concat_ws("|", F.lit(seed), "u", "v")), "u", "v").limit(k).select("u", "v", F.lit(1.0).alias("w"))
    if mode == "norm":
        edges = edges.select("u", "v", F.least(w, F.lit(cap)).alias("w"))
        # the largest of all edges is the largest of the k kept ones
    top = edges.orderBy(F.desc("w"), "u", "v").limit(k)
    if mode in ("norm", "scale"):
        return top.select("u", "v", (w / F.max("w").over(every)).alias("w"))
    if mode == "stretch":
        least, most = F.min("w").over(every), F.max("w").over(every)
        floor = least * low
        return top.select("u", "v", F.when(most > least, floor + (w - least) / (most - least) * (most - floor)).otherwise(most).alias("w"))
    if mode == "topall1":
        return top.select("u", "v", F.lit(1.0).alias("w"))
    if mode == "none":
        return top
    raise ValueError(mode)


def drop_hub_edges(edges: DataFrame, k: int, degree: int) -> DataFrame:
    """Of the k heaviest edges, those that touch no node with `degree` or more of them."""
    top = edges.orderBy(F.desc("w"), "u", "v").limit(k)
    hubs = top.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").count().where(F.col("count") >= degree)
    u, v = hubs.select(F.col("node").alias("u")), hubs.select(F.col("node").alias("v"))
    return top.join(u, "u", "left_anti").join(v, "v", "left_anti").select("u", "v", "w")


def limit_degree(edges: DataFrame, k: int, degree: int) -> DataFrame:
    """Of the k heaviest edges, in order: an edge is skipped if either end already has `degree` kept ones. The order decides, so
    the k edges (a bound that the caller states) pass through one task."""

    def pick(frames):
        import pandas as pd

        frame = pd.concat(list(frames)) if (frames := list(frames)) else None
        if frame is None or frame.empty:
            return
        frame = frame.sort_values(["w", "u", "v"], ascending=[False, True, True])
        used: dict[str, int] = {}
        kept = []
        for u, v in zip(frame.u, frame.v, strict=True):
            ok = used.get(u, 0) < degree and used.get(v, 0) < degree
            kept.append(ok)
            if ok:
                used[u], used[v] = used.get(u, 0) + 1, used.get(v, 0) + 1
        yield frame[kept]

    return edges.orderBy(F.desc("w"), "u", "v").limit(k).coalesce(1).mapInPandas(pick, edges.select("u", "v", "w").schema)


def subtype_edges(evidence: DataFrame, subtype: str, top: int | None = None) -> DataFrame:
    """Edges of one subtype without loops, heaviest first; at most `top` of them if that is given."""
    out = evidence.where((F.col("subtype") == subtype) & (F.col("u") != F.col("v"))).select("u", "v", F.col("score").alias("w"))
    return out.orderBy(F.desc("w"), "u", "v").limit(top) if top else out


def keep_evidence(evidence: DataFrame, subtypes: list[str]) -> DataFrame:
    """Evidence rows of pairs that have a nonzero score in any of the subtypes, of these subtypes only."""
    return evidence.where(F.col("subtype").isin(subtypes) & (F.col("score") != 0))
