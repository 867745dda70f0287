"""Supervised edge scores from several kinds of evidence: evidence(u, v, subtype, score) long, labels(u, v, cls)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsets.operators.graph import adjacency, triangles
from netsets.operators.kernels import mdl_cuts, pool_ratios
from netsets.plans.lineage import cut, small


def clean(rows: DataFrame) -> DataFrame:
    """Ids in capitals, no loops, u < v, blank subtype `Undefined`, blank score 1; of repeated (pair, subtype) the larger absolute score."""
    a, b = F.upper("u"), F.upper("v")
    named = rows.where(a != b).select(
        F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), F.coalesce(F.nullif(F.trim("subtype"), F.lit("")), F.lit("Undefined")).alias("subtype"), F.coalesce("score", F.lit(1.0)).alias("score")
    )
    return named.groupBy("u", "v", "subtype").agg(F.max_by("score", F.struct(F.abs("score"), "score")).alias("score"))


def pivoted(evidence: DataFrame, subtypes: list[str]) -> DataFrame:
    """u, v and a column per subtype, 0 where there is none. The list of subtypes is stated, so no pass is needed to find it."""
    return evidence.groupBy("u", "v").pivot("subtype", subtypes).agg(F.max("score")).na.fill(0.0)


def label_edges(pairs: DataFrame, refs_x: DataFrame) -> DataFrame:
    """u, v, cls: 1 if the ends share a set, else 0."""
    a, b = refs_x.select(F.col("node").alias("u"), "cid"), refs_x.select(F.col("node").alias("v"), "cid")
    together = pairs.join(a, "u").join(b, ["v", "cid"]).select("u", "v").distinct()
    return pairs.join(together.withColumn("cls", F.lit(1)), ["u", "v"], "left").na.fill(0, ["cls"]).select("u", "v", "cls")


def label_border(pairs: DataFrame, refs_x: DataFrame) -> DataFrame:
    """u, v, label: complex, border (one or both ends in some set, not shared) or outside."""
    known = refs_x.select("node").distinct()
    ku, kv = known.select(F.col("node").alias("u"), F.lit(1).alias("iu")), known.select(F.col("node").alias("v"), F.lit(1).alias("iv"))
    joined = label_edges(pairs, refs_x).join(ku, "u", "left").join(kv, "v", "left")
    return joined.select("u", "v", F.when(F.col("cls") == 1, "complex").when(F.coalesce("iu", "iv") == 1, "border").otherwise("outside").alias("label"))


def label_sizes(pairs: DataFrame, refs_x: DataFrame) -> DataFrame:
    """u, v, cls: 0 not together, 2 together in a set of 2 or 3 at most, 4 in a larger one (the largest class counts)."""
    size = refs_x.groupBy("cid").agg(F.when(F.count(F.lit(1)) >= 4, 4).otherwise(2).alias("c"))
    sized = refs_x.join(size, "cid")
    a, b = sized.select(F.col("node").alias("u"), "cid", "c"), refs_x.select(F.col("node").alias("v"), "cid")
    top = pairs.join(a, "u").join(b, ["v", "cid"]).groupBy("u", "v").agg(F.max("c").alias("cls"))
    return pairs.select("u", "v").join(top, ["u", "v"], "left").na.fill(0, ["cls"])


def histogram(evidence: DataFrame, labels: DataFrame, implicit_zeros: bool = False) -> DataFrame:
    """subtype, value, cls, n: what cut search needs, however many edges there are. With implicit zeros, labelled pairs without a
    row of the subtype count as value 0, by arithmetic on the totals."""
    rows = evidence.join(labels, ["u", "v"]).groupBy("subtype", F.col("score").alias("value"), "cls").agg(F.count(F.lit(1)).alias("n"))
    if not implicit_zeros:
        return rows
    totals = labels.groupBy("cls").agg(F.count(F.lit(1)).alias("total"))
    present = rows.groupBy("subtype", "cls").agg(F.sum("n").alias("present"))
    every = rows.select("subtype").distinct().crossJoin(small(totals)).join(present, ["subtype", "cls"], "left")
    missing = every.select("subtype", F.lit(0.0).alias("value"), "cls", (F.col("total") - F.coalesce("present", F.lit(0))).alias("n")).where("n > 0")
    return rows.unionByName(missing).groupBy("subtype", "value", "cls").agg(F.sum("n").alias("n"))


def cut_points(hist: DataFrame, alpha: float = 1.0, recursive: bool = True) -> DataFrame:
    """subtype, cuts: entropy cuts that the minimum description length accepts, between distinct values. One small histogram a group."""

    def per_subtype(frame):
        import pandas as pd

        cuts = mdl_cuts(frame["value"].to_numpy(float), frame["cls"].to_numpy(), frame["n"].to_numpy(float), alpha, recursive)
        return pd.DataFrame({"subtype": [frame["subtype"].iloc[0]], "cuts": [cuts]})

    return hist.groupBy("subtype").applyInPandas(per_subtype, "subtype string, cuts array<double>")


def selected_subtypes(hist: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Subtypes with an accepted cut."""
    return cut_points(hist, alpha, recursive=False).where(F.size("cuts") > 0).select("subtype")


def select_features(evidence: DataFrame, labels: DataFrame, alpha: float = 1.0) -> list[str]:
    """Selects subtypes, keeps the edges that have them, and selects again until their number is stable."""
    chosen = sorted(r.subtype for r in evidence.select("subtype").distinct().collect())
    while True:
        kept = evidence.where(F.col("subtype").isin(chosen) & (F.col("score") != 0))
        pairs = labels.join(kept.select("u", "v").distinct(), ["u", "v"], "left_semi")
        now = sorted(r.subtype for r in selected_subtypes(histogram(kept, pairs), alpha).collect())
        if len(now) == len(chosen) or not now:
            return now
        chosen = now


def apply_cuts(evidence: DataFrame, cuts: DataFrame, no_cut_shift: bool = False) -> DataFrame:
    """u, v, subtype, bin: how many cuts lie below the score. no_cut_shift treats `no cut` as a cut at -1, as the published tables do."""
    c = F.when(F.size("cuts") == 0, F.array(F.lit(-1.0))).otherwise(F.col("cuts")) if no_cut_shift else F.col("cuts")
    return evidence.join(small(cuts), "subtype").select("u", "v", "subtype", F.size(F.filter(c, lambda x: x < F.col("score"))).alias("bin"))


def likelihoods(binned: DataFrame, labels: DataFrame, cumulative: bool = False, shared_totals: bool = False) -> DataFrame:
    """subtype, bin, cls, likelihood = (n + 1) / (class total + bins): Laplace counts over all (subtype, bin, class) that occur in
    any class. shared_totals adds the bins of all subtypes to the totals, as the published tables do."""
    counts = binned.join(labels, ["u", "v"]).groupBy("subtype", "bin", "cls").agg(F.count(F.lit(1)).alias("n"))
    classes = cut(labels.groupBy("cls").agg(F.count(F.lit(1)).alias("total")))
    cells = cut(binned.select("subtype", "bin").distinct())
    grid = cells.crossJoin(small(classes)).join(counts, ["subtype", "bin", "cls"], "left").na.fill(0, ["n"])
    if cumulative:
        grid = grid.withColumn("n", F.sum("n").over(Window.partitionBy("subtype", "cls").orderBy(F.desc("bin"))))
    bins = cells.groupBy("subtype").agg(F.count(F.lit(1)).alias("bins"))
    if shared_totals:
        bins = bins.withColumn("bins", F.sum("bins").over(Window.partitionBy()))
    return grid.join(small(bins), "subtype").select("subtype", "bin", "cls", ((F.col("n") + 1) / (F.col("total") + F.col("bins"))).alias("likelihood"))


def smooth(table: DataFrame) -> DataFrame:
    """likelihoods of classes 1 and 0 with neighbouring bins pooled until their ratio does not fall."""

    def per_subtype(frame):
        wide = frame.pivot_table(index="bin", columns="cls", values="likelihood").sort_index()
        one, zero = pool_ratios(wide[1].to_numpy(), wide[0].to_numpy())
        wide[1], wide[0] = one, zero
        out = wide.reset_index().melt(id_vars="bin", var_name="cls", value_name="likelihood")
        out["subtype"] = frame["subtype"].iloc[0]
        return out[["subtype", "bin", "cls", "likelihood"]]

    return table.groupBy("subtype").applyInPandas(per_subtype, "subtype string, bin int, cls int, likelihood double")


def posteriors(binned: DataFrame, table: DataFrame, priors: DataFrame, damp: float = 1.0) -> DataFrame:
    """u, v, cls, p: naive Bayes over an edge's subtypes; any number of classes. priors(cls, prior); damp is an exponent of the likelihoods."""
    logs = binned.join(small(table), ["subtype", "bin"]).groupBy("u", "v", "cls").agg((F.sum(F.log("likelihood")) * damp).alias("l"))
    scored = logs.join(small(priors), "cls").withColumn("l", F.col("l") + F.log("prior"))
    pair = Window.partitionBy("u", "v")
    # differences of logarithms: many small factors never underflow
    shifted = scored.withColumn("e", F.exp(F.col("l") - F.max("l").over(pair)))
    return shifted.select("u", "v", "cls", (F.col("e") / F.sum("e").over(pair)).alias("p"))


def class_priors(labels: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return labels.groupBy("cls").agg(n.alias("n")).select("cls", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("prior"))


def likelihood_ratio(binned: DataFrame, table: DataFrame) -> DataFrame:
    """u, v, w: product over subtypes of the likelihood of class 1 over that of class 0."""
    sign = F.when(F.col("cls") == 1, 1).otherwise(-1)
    return binned.join(small(table.where("cls in (0, 1)")), ["subtype", "bin"]).groupBy("u", "v").agg(F.exp(F.sum(sign * F.log("likelihood"))).alias("w"))


def posterior_ratio(binned: DataFrame, table: DataFrame, priors: DataFrame, damp: float = 1.0) -> DataFrame:
    """u, v, w: the posterior of class 1 over that of class 0."""
    p = posteriors(binned, table, priors, damp).groupBy("u", "v").pivot("cls", [1, 0]).agg(F.max("p")).toDF("u", "v", "one", "zero")
    return p.select("u", "v", (F.col("one") / F.col("zero")).alias("w"))


def first_value(evidence: DataFrame, subtypes: list[str], flat: bool = False) -> DataFrame:
    """u, v, w: an edge's first score that is not zero, in the order of the subtypes (flat: 1 for every edge that has one)."""
    rank = F.coalesce(*[F.when(F.col("subtype") == s, F.lit(i)) for i, s in enumerate(subtypes)])
    ranked = evidence.where(F.col("subtype").isin(subtypes) & (F.col("score") != 0)).withColumn("r", rank)
    first = ranked.groupBy("u", "v").agg(F.min_by("score", "r").alias("w"))
    return first.withColumn("w", F.lit(1.0)) if flat else first


def string_score(evidence: DataFrame, prior: float = 0.0) -> DataFrame:
    """u, v, w: probabilities of independent evidence joined, 1 - product of (1 - score)."""
    return evidence.groupBy("u", "v").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-12))))) * (1 - prior)).alias("w"))


def isolatedness(scored: DataFrame, threshold: float = 1e-7, cap: float = 0.9999, cap_triangles: bool = True) -> DataFrame:
    """u, v, iso from scored(u, v, s2, s4): s2 times the chance that no other edge of either end is real, and for each triangle
    of s2 edges the like product of the triangle. cap_triangles=False leaves the triangle factors at 1 - s, as the published code does."""
    strong = cut(scored.where(F.col("s2") + F.col("s4") >= threshold))
    # logarithms of (1 - score) summed per node once; an edge takes its own part out again
    def logs(limit: bool):
        s = F.col("s2") + F.col("s4")
        return F.log(F.greatest(1 - F.least(s, F.lit(cap)) if limit else 1 - s, F.lit(1e-300)))

    withl = cut(strong.withColumn("l", logs(True)).withColumn("t", logs(cap_triangles)))
    ends = withl.select(F.explode(F.array("u", "v")).alias("node"), "l", "t").groupBy("node").agg(F.sum("l").alias("nl"), F.sum("t").alias("nt"))
    ends = cut(ends)
    nu, nv = ends.select(F.col("node").alias("u"), F.col("nl").alias("lu")), ends.select(F.col("node").alias("v"), F.col("nl").alias("lv"))
    edge = withl.where(F.col("s2") >= threshold).join(nu, "u").join(nv, "v")
    edge = edge.select("u", "v", (F.col("s2") * F.exp(F.col("lu") + F.col("lv") - 2 * F.col("l"))).alias("own"))
    real = withl.where(F.col("s2") >= threshold).select("u", "v", F.struct("s2", "t").alias("w"))
    tri = triangles(real)
    for c in "abc":
        tri = tri.join(ends.select(F.col("node").alias(c), F.col("nt").alias(f"n{c}")), c)
    inner = F.col("wab.t") + F.col("wac.t") + F.col("wbc.t")
    score = F.col("wab.s2") * F.col("wac.s2") * F.col("wbc.s2") * F.exp(F.col("na") + F.col("nb") + F.col("nc") - 2 * inner)
    parts = tri.select(score.alias("x"), F.explode(F.array(*[F.struct(F.col(p).alias("u"), F.col(q).alias("v")) for p, q in ("ab", "ac", "bc")])).alias("e"))
    extra = parts.groupBy("e.u", "e.v").agg(F.sum("x").alias("x"))
    joined = scored.select("u", "v").join(edge, ["u", "v"], "left").join(extra, ["u", "v"], "left")
    return joined.select("u", "v", (F.coalesce("own", F.lit(0.0)) + F.coalesce("x", F.lit(0.0))).alias("iso"))


def iso_em(evidence: DataFrame, labels: DataFrame, rounds: int = 2, alpha: float = 1.0) -> DataFrame:
    """u, v, s0, s2, s4: three-class scores; each round adds the isolatedness of the last scores as one more subtype and learns again."""
    current, scores = evidence, None
    priors = cut(class_priors(labels))
    for step in range(rounds + 1):
        cuts = cut(cut_points(histogram(current, labels), alpha))
        binned = cut(apply_cuts(current, cuts))
        p = posteriors(binned, likelihoods(binned, labels), priors)
        scores = cut(p.groupBy("u", "v").pivot("cls", [0, 2, 4]).agg(F.max("p")).na.fill(0.0).toDF("u", "v", "s0", "s2", "s4"))
        if step < rounds:
            iso = isolatedness(scores).select("u", "v", F.lit("ISO2").alias("subtype"), F.col("iso").alias("score"))
            current = cut(evidence.unionByName(iso))
    return scores


def training_labels(pairs: DataFrame, refs_x: DataFrame, xval: DataFrame) -> DataFrame:
    """iteration, u, v, cls: labels from the sets that the iteration does not test."""
    turns = xval.select("iteration").distinct()
    a, b = refs_x.select(F.col("node").alias("u"), "cid"), refs_x.select(F.col("node").alias("v"), "cid")
    together = pairs.select("u", "v").join(a, "u").join(b, ["v", "cid"])
    train = together.crossJoin(small(turns)).join(xval, ["iteration", "cid"], "left_anti").select("iteration", "u", "v").distinct()
    every = pairs.select("u", "v").crossJoin(small(turns))
    return every.join(train.withColumn("cls", F.lit(1)), ["iteration", "u", "v"], "left").na.fill(0, ["cls"])


def strong_neighbours(scored: DataFrame, threshold: float = 1e-7) -> DataFrame:
    """src, dst with s2 + s4 at the threshold, both ways."""
    return adjacency(scored.where(F.col("s2") + F.col("s4") >= threshold).withColumn("w", F.col("s2") + F.col("s4"))).select("src", "dst", "w")
