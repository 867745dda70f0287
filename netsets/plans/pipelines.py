"""The three published pipelines as compositions of operators: every stage is a DataFrame, nothing passes through files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsets.operators import clusters as C
from netsets.operators import evidence as E
from netsets.operators import filters as FL
from netsets.operators import graph as G
from netsets.operators import metrics as M
from netsets.operators import ontology as O
from netsets.operators import partition as P
from netsets.operators import small_sets as S
from netsets.operators import weights as W
from netsets.plans.lineage import cut

METHODS = ("coherent", "complement", "cohesive")
PUBLISHED = ("merged_cliques", "dense_growth", "cores_and_attachments")


def denoise(net: DataFrame, refs_x: DataFrame, negative: DataFrame | None = None, mode: str = "perpair", confidence: float = 0.0, direct: DataFrame | None = None) -> DataFrame:
    """Negative list out, then: perpair, perprotein, direct, or none. Another mode is an error."""
    edges = FL.drop_listed(net, negative) if negative is not None else net
    if mode == "perpair":
        return FL.keep_pairs(edges, refs_x, confidence)
    if mode == "perprotein":
        return FL.keep_members(edges, refs_x, confidence)
    if mode == "direct" and direct is not None:
        return FL.keep_direct(edges, direct)
    if mode == "none":
        return edges
    raise ValueError(f"mode {mode!r} with direct={direct is not None}")


def partition(edges: DataFrame, method: str) -> DataFrame:
    if method == "coherent":
        return P.coherent_partition(edges)
    if method == "complement":
        return P.complement_partition(edges)
    if method == "cohesive":
        return P.cohesive_sets(edges)
    return P.published_sets(edges, method)


def evaluate(scored: DataFrame, sets_x: DataFrame, refs_x: DataFrame, method: str, gold: str, network: str) -> DataFrame:
    """The metrics row: method, gold, network, counts and eleven measures."""
    rated = M.precision_recall(sets_x, refs_x)
    parts = [
        M.auc_pr(scored, sets_x, refs_x).select(F.coalesce("auc", F.lit(0.0)).alias("auc_pr")),
        P.matching_ratio(sets_x, refs_x).select(F.col("ratio").alias("mmr")),
        M.accuracy(sets_x, refs_x),
        M.fraction_matched(sets_x, refs_x),
        M.separation(sets_x, refs_x),
    ]
    row = reduce(lambda a, b: a.join(F.broadcast(b), how="left"), parts, rated)  # one row each
    names = [F.lit(method).alias("method"), F.lit(gold).alias("gold"), F.lit(network).alias("network"), "n_preds", "n_refs"]
    return row.select(*names, *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "f2", "auc_pr", "mmr", "sensitivity", "ppv", "accuracy", "fraction_matched", "separation")])


def single(net: DataFrame, refs_x: DataFrame, method: str, network: str, gold: str, mode: str = "perpair") -> DataFrame:
    """One method: denoise, partition, score by member order, greedy deduplication, metrics."""
    edges = cut(denoise(net, refs_x, mode=mode))
    sets_x = cut(partition(edges, method))
    listed = sets_x.groupBy("cid").agg(F.sort_array(F.collect_list("node")).alias("m")).where(F.size("m") > 1)
    scored = cut(C.ordered_density(listed.select("cid", F.posexplode("m").alias("pos", "node")), edges).select("cid", "score"))
    kept = cut(C.dedup(scored, sets_x))
    return evaluate(kept, sets_x.join(kept, "cid", "left_semi"), refs_x, method, gold, network)


def ensemble(net: DataFrame, refs_x: DataFrame, negative: DataFrame, network: str, gold: str, mode: str = "perpair", threshold: float = 0.3) -> DataFrame:
    """Denoise, re-weigh, take hubs out, partition in two ways, give hubs back; add cohesive sets of the denoised network; concatenate
    and evaluate. The denoised network feeds four consumers and is written once."""
    edges = cut(denoise(net, refs_x, negative, mode))
    weights = cut(W.adjust_cd(edges))
    hubs = cut(P.hubs(edges))
    left = cut(G.without(edges, hubs))
    scored = []
    for method in ("coherent", "complement"):
        back = C.return_hubs(partition(left, method), hubs, weights, edges, threshold)
        scored.append(back.select(F.concat_ws(":", F.lit(method), "cid").alias("cid"), "node", "score"))
    own = partition(edges, "cohesive")
    listed = own.groupBy("cid").agg(F.sort_array(F.collect_list("node")).alias("m"))
    dens = C.ordered_density(listed.select("cid", F.posexplode("m").alias("pos", "node")), net).select("cid", "score")
    scored.append(own.join(dens, "cid").select(F.concat_ws(":", F.lit("cohesive"), "cid").alias("cid"), "node", "score"))
    sets = cut(reduce(DataFrame.unionByName, scored))
    return evaluate(sets.select("cid", "score").distinct(), sets.select("cid", "node"), refs_x, "ensemble", gold, network)


def no_terms(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An empty ontology: links, annots, terms."""
    return (spark.createDataFrame([], "child string, parent string"), spark.createDataFrame([], "node string, term string"), spark.createDataFrame([], "term string"))


def supervised(evidence: DataFrame, refs_x: DataFrame, top: int = 20_000) -> DataFrame:
    """Edge scores learned from evidence, the best `top` normalised."""
    labels = cut(E.label_edges(evidence.select("u", "v").distinct(), refs_x))
    binned = cut(E.apply_cuts(evidence, cut(E.cut_points(E.histogram(evidence, labels)))))
    p = E.posteriors(binned, E.likelihoods(binned, labels), E.class_priors(labels)).where("cls = 1")
    return FL.rescaled_top(p.select("u", "v", F.col("p").alias("w")), top, "norm")


def clustered(edges: DataFrame, least_size: int = 4, threshold: float = 0.75) -> DataFrame:
    """cid, node, score: sets of at least that size by every overlapping method, scored by weighted density and combined."""
    found = [("cohesive", P.cohesive_sets(edges, least_size=least_size, density=0.0))]
    found += [(method, P.published_sets(edges, method)) for method in PUBLISHED]
    sets = reduce(DataFrame.unionByName, [x.select(F.concat_ws(":", F.lit(method), "cid").alias("cid"), "node", F.lit(method).alias("src")) for method, x in found])
    sets = cut(sets)
    sizes = C.sizes(sets).where(F.col("size") >= least_size)
    sets = sets.join(sizes.select("cid"), "cid", "left_semi")
    scored = cut(C.weighted_density(sets, edges).select("cid", "score").join(sets.select("cid", "src").distinct(), "cid"))
    both = cut(C.combine(scored, sets.select("cid", "node"), len(found), threshold).select("cid", "score"))
    return sets.select("cid", "node").join(both, "cid")


def decomposed(edges: DataFrame, ontology: tuple[DataFrame, DataFrame, DataFrame], hub_degree: int = 50, threshold: float = 0.3) -> DataFrame:
    """cid, node, score: hubs out, a subnetwork per term (one without terms), sets of each, recombined, hubs back."""
    _, annots, terms = ontology
    hubs = cut(G.hubs_fixed(edges, hub_degree))
    left = cut(G.without(edges, hubs))
    nets = left.withColumn("term", F.lit("all")) if terms.isEmpty() else O.subnetworks(left, annots, terms)
    # ids carry the term, so that one pass over all terms' components keeps subnetworks apart
    tagged = cut(nets.select(F.concat_ws("\t", "term", "u").alias("u"), F.concat_ws("\t", "term", "v").alias("v"), "w"))
    sets = clustered(tagged)
    rows = cut(sets.select(F.split("node", "\t")[0].alias("term"), "cid", F.split("node", "\t")[1].alias("node")))
    first = cut(C.recombine(rows, edges))
    named = cut(rows.select(F.concat_ws("/", "term", "cid").alias("cid"), "node").join(first.select("cid"), "cid", "left_semi"))
    back, rescored = C.readd_scored(first.select("cid", "score"), named, hubs, edges, edges, threshold)
    return back.join(cut(rescored), "cid")


def small(evidence: DataFrame, refs_x: DataFrame, ontology: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """cid, node, score: sets of two and three from size-specific scores, weighed down where the ontology keeps their nodes apart."""
    labels = cut(E.label_sizes(evidence.select("u", "v").distinct(), refs_x))
    s = E.iso_em(evidence, labels)
    scored = cut(s.select("u", "v", F.col("s2").alias("w")))
    two = S.pairs_of_two(scored, large=s.select("u", "v", F.col("s4").alias("w")))
    three = S.sets_of_three(scored)
    out = two.select(F.array("u", "v").alias("m"), "score").unionByName(three.select(F.array("a", "b", "c").alias("m"), "score"))
    out = cut(out.select(F.array_join("m", "+").alias("cid"), "m", "score"))
    sets = out.select("cid", F.explode("m").alias("node"))
    links, annots, terms = ontology
    if not terms.isEmpty():
        bad = cut(O.incompatible_edges(evidence.select("u", "v").distinct(), annots, links, terms))
        out = O.down_weight(out.select("cid", "score"), sets, bad)
    return sets.join(out.select("cid", "score"), "cid")


def integrated(evidence: DataFrame, refs_x: DataFrame, ontology: tuple[DataFrame, DataFrame, DataFrame], factors: dict[str, float] | None = None) -> DataFrame:
    """cid, score, sources of the three-part pipeline. Evidence is computed once for all parts."""
    evidence = cut(evidence)
    edges = cut(supervised(evidence, refs_x))
    rows = [(clustered(edges), "swc"), (decomposed(edges, ontology), "decomp"), (small(evidence, refs_x, ontology), "small")]
    named = cut(reduce(DataFrame.unionByName, [d.select(F.concat_ws(":", F.lit(s), "cid").alias("cid"), "node", "score", F.lit(s).alias("src")) for d, s in rows]))
    scored = named.select("cid", "src", "score").distinct()
    out = C.integrate(scored, named.select("cid", "node"), factors or {"swc": 1.0, "decomp": 0.6, "small": 1.0}, small_from="small")
    return out.select("cid", F.round("score", 6).alias("score"), "sources")


def grid(nets: dict[str, DataFrame], golds: dict[str, DataFrame], mode: str = "perpair") -> DataFrame:
    """One metrics row for each network, gold standard and method."""
    return reduce(DataFrame.unionByName, [single(net, refs, m, n, g, mode) for n, net in nets.items() for g, refs in golds.items() for m in METHODS])
