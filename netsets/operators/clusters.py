"""Scoring, deduplication and combination of sets; exploded form (cid, node), scored form (cid, score) beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsets.functions.sets import jaccard, size_aware_match
from netsets.plans.lineage import cut


def sizes(sets_x: DataFrame) -> DataFrame:
    return sets_x.groupBy("cid").agg(F.countDistinct("node").alias("size"))


def inner_weight(sets_x: DataFrame, edges: DataFrame) -> DataFrame:
    """cid, size, n_inner, inner: edges with both ends in the set. Looks up each edge's sets; makes no pairs of members."""
    a = sets_x.select("cid", F.col("node").alias("u"))
    b = sets_x.select("cid", F.col("node").alias("v"))
    inside = edges.join(a, "u").join(b, ["cid", "v"]).groupBy("cid").agg(F.count(F.lit(1)).alias("n_inner"), F.sum("w").alias("inner"))
    return sizes(sets_x).join(inside, "cid", "left").na.fill(0, ["n_inner"]).na.fill(0.0, ["inner"])


def weighted_density(sets_x: DataFrame, edges: DataFrame, doubled: bool = False, count: bool = False) -> DataFrame:
    """cid, size, score: weight inside over possible pairs; doubled counts ordered pairs twice; count takes each positive edge as 1."""
    top = F.col("n_inner").cast("double") if count else F.col("inner")
    kept = edges.where("w > 0") if count else edges
    pairs = F.col("size") * (F.col("size") - 1)
    score = F.when(pairs > 0, (4 if doubled else 2) * top / pairs).otherwise(F.lit(0.0))
    return inner_weight(sets_x, kept).select("cid", "size", score.alias("score"))


def ordered_density(sets_pos: DataFrame, edges: DataFrame) -> DataFrame:
    """cid, size, score of sets with member order (cid, node, pos): (4W - 2W0) / (n(n-1)), W0 the weight at the first member."""
    first = sets_pos.where("pos = 0").select("cid", F.col("node").alias("head"))
    a, b = sets_pos.select("cid", F.col("node").alias("u")), sets_pos.select("cid", F.col("node").alias("v"))
    inside = edges.join(a, "u").join(b, ["cid", "v"]).join(first, "cid")
    at_head = (F.col("u") == F.col("head")) | (F.col("v") == F.col("head"))
    sums = inside.groupBy("cid").agg(F.sum("w").alias("whole"), F.sum(F.when(at_head, F.col("w")).otherwise(0.0)).alias("head_w"))
    joined = sizes(sets_pos).join(sums, "cid", "left").na.fill(0.0, ["whole", "head_w"])
    pairs = F.col("size") * (F.col("size") - 1)
    return joined.select("cid", "size", F.when(pairs > 0, (4 * F.col("whole") - 2 * F.col("head_w")) / pairs).otherwise(F.lit(0.0)).alias("score"))


def coherence(sets_x: DataFrame, edges: DataFrame) -> DataFrame:
    """cid, size, score: share of the weight that stays inside, times density."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("node"), "w")
    touching = sets_x.join(ends, "node").groupBy("cid").agg(F.sum("w").alias("ends"))  # inner edges twice, leaving ones once
    joined = inner_weight(sets_x, edges).join(touching, "cid", "left").na.fill(0.0, ["ends"])
    pairs, whole = F.col("size") * (F.col("size") - 1), F.col("ends") - F.col("inner")
    score = F.when((pairs > 0) & (whole > 0), F.col("inner") / whole * 2 * F.col("inner") / pairs).otherwise(F.lit(0.0))
    return joined.select("cid", "size", score.alias("score"))


def overlaps(a_x: DataFrame, b_x: DataFrame) -> DataFrame:
    """a, b, both, na, nb for sets that share a member: an inverted index on members, so disjoint pairs never appear."""
    # the stated filter is the one that the join implies, so that the sizes reuse the exchange of the members
    left = a_x.where("node is not null").select(F.col("cid").alias("a"), "node").distinct()
    right = b_x.where("node is not null").select(F.col("cid").alias("b"), "node").distinct()
    both = left.join(right, "node").groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    na, nb = left.groupBy("a").agg(F.count(F.lit(1)).alias("na")), right.groupBy("b").agg(F.count(F.lit(1)).alias("nb"))
    return both.join(na, "a").join(nb, "b")


def match_pairs(sets_x: DataFrame, threshold: float, aware: bool = True, over: int = 0) -> DataFrame:
    """(a, b), both ways, of different sets that match at the threshold; sets of at most `over` members match none."""
    both, na, nb = F.col("both"), F.col("na"), F.col("nb")
    score = size_aware_match(both, na, nb) if aware else jaccard(both, na, nb)
    return overlaps(sets_x, sets_x).where("a <> b").where((na > over) & (nb > over) & (score >= threshold)).select("a", "b")


def greedy_keep(ranked: DataFrame, pairs: DataFrame) -> DataFrame:
    """cid of the sets that a pass in order of `place` keeps: each that matches no kept earlier one.

    That is the lexicographically first independent set: in rounds, a set all of whose earlier matches are out stays, and what
    matches it later goes. ranked(cid, place), pairs(a, b) both ways.
    """
    pa = ranked.select(F.col("cid").alias("a"), F.col("place").alias("pa"))
    pb = ranked.select(F.col("cid").alias("b"), F.col("place").alias("pb"))
    later = cut(pairs.join(pa, "a").join(pb, "b").where("pb < pa").select("a", "b"))  # b comes before a
    undecided, kept = cut(ranked.select("cid")), None
    while not undecided.isEmpty():
        waiting = later.select(F.col("a").alias("cid")).distinct()
        stays = cut(undecided.join(waiting, "cid", "left_anti"))
        goes = cut(later.join(stays.select(F.col("cid").alias("b")), "b", "left_semi").select(F.col("a").alias("cid")).distinct())
        kept = stays if kept is None else kept.unionByName(stays)
        decided = stays.unionByName(goes)
        undecided = cut(undecided.join(decided, "cid", "left_anti"))
        out_a, out_b = goes.select(F.col("cid").alias("a")), goes.select(F.col("cid").alias("b"))
        later = later.join(out_a, "a", "left_anti").join(out_b, "b", "left_anti")
        later = cut(later.join(stays.select(F.col("cid").alias("b")), "b", "left_anti"))
    return kept if kept is not None else ranked.select("cid").limit(0)


def dedup(scored: DataFrame, sets_x: DataFrame, threshold: float = 0.75, by_score: bool = False, aware: bool = True) -> DataFrame:
    """Rows of scored(cid, score, ...) that the greedy pass keeps, in order of cid or of falling score."""
    # the order is a comparison of two rows; a rank per row would need all of them in one task
    place = F.struct((-F.col("score")).alias("s"), F.col("cid").alias("c")) if by_score else F.struct(F.col("cid").alias("c"))
    kept = greedy_keep(scored.select("cid", place.alias("place")), match_pairs(sets_x, threshold, aware))
    return scored.join(kept, "cid", "left_semi")


def dedup_exact(sets_x: DataFrame) -> DataFrame:
    """cid of the first of equal sets."""
    keyed = sets_x.groupBy("cid").agg(F.array_join(F.sort_array(F.collect_set("node")), " ").alias("key"))
    return keyed.groupBy("key").agg(F.min("cid").alias("cid")).select("cid")


def dedup_by_id(rows: DataFrame, order: Column) -> DataFrame:
    """The first row of each cid."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("cid").orderBy(order))).where("_n = 1").drop("_n")


def vote(scored: DataFrame, sets_x: DataFrame, threshold: float = 0.75, least: int = 1) -> DataFrame:
    """Ensemble by votes over scored(cid, src, score): a set stays if sets of `least` other sources match it; of the set and its best
    match in each source, the highest score survives (ties: the set itself, then cid). Returns survivors, once each."""
    src = scored.select("cid", "src", "score")
    a, b = (src.select(F.col("cid").alias(c), F.col("src").alias(f"s{c}"), F.col("score").alias(f"w{c}")) for c in "ab")
    pairs = match_pairs(sets_x, threshold).join(a, "a").join(b, "b").where("sa <> sb")
    first = pairs.groupBy("a", "wa", "sb").agg(F.min(F.struct("b", "wb")).alias("m"))  # the first match of a source votes
    best = F.max(F.struct(F.col("m.wb").alias("w"), F.col("m.b").alias("b")))
    votes = first.groupBy("a", "wa").agg(F.count(F.lit(1)).alias("n"), best.alias("m")).where(F.col("n") >= least)
    return votes.select(F.when(F.col("m.w") > F.col("wa"), F.col("m.b")).otherwise(F.col("a")).alias("cid")).distinct()


def combine(scored: DataFrame, sets_x: DataFrame, n_sources: int, threshold: float = 0.75, add: bool = True, aware: bool = False, over: int = 0) -> DataFrame:
    """cid, score, sources: sets of several sources grouped around representatives in score order. Each source is deduplicated by
    itself first (unless the threshold is 1). Each set that is not kept joins the first kept one (in that order) it matches; every source
    counts once, with its best member; the sum is divided by n_sources. add=False takes the best score instead. Sets match by their
    plain Jaccard similarity (aware=True: by size class too); those of at most `over` members match none."""
    place = F.struct((-F.col("score")).alias("s"), F.col("cid").alias("c"))
    ranked = scored.select("cid", "src", "score", place.alias("place"))
    pairs = cut(match_pairs(sets_x, threshold, aware, over))
    if threshold < 1:
        a, b = (scored.select(F.col("cid").alias(c), F.col("src").alias(f"s{c}")) for c in "ab")
        alone = pairs.join(a, "a").join(b, "b").where("sa = sb").select("a", "b")
        ranked = cut(ranked.join(greedy_keep(ranked.select("cid", "place"), alone), "cid", "left_semi"))
        pairs = pairs.join(ranked.select(F.col("cid").alias("a")), "a", "left_semi").join(ranked.select(F.col("cid").alias("b")), "b", "left_semi")
        pairs = cut(pairs.select("a", "b"))
    kept = cut(greedy_keep(ranked.select("cid", "place"), pairs))
    rep = ranked.join(kept, "cid", "left_semi").select(F.col("cid").alias("b"), F.col("place").alias("pb"))
    rest = ranked.join(kept, "cid", "left_anti").select(F.col("cid").alias("a"), "src", "score", "place")
    joined = rest.join(pairs, "a").join(rep, "b").where("pb < place").groupBy("a", "src", "score").agg(F.min_by("b", "pb").alias("cid"))
    own = ranked.join(kept, "cid", "left_semi").select("cid", "src", "score")
    per_source = own.unionByName(joined.select("cid", "src", "score")).groupBy("cid", "src").agg(F.max("score").alias("score"))
    total = F.sum("score") / n_sources if add else F.max("score")
    return per_source.groupBy("cid").agg(total.alias("score"), F.array_join(F.sort_array(F.collect_set("src")), ",").alias("sources"))


def integrate(scored: DataFrame, sets_x: DataFrame, factors: dict[str, float], threshold: float = 0.75, least_score: float = 1e-4, small_from: str | None = None, add: bool = True) -> DataFrame:
    """As combine, after dropping low scores, weighing each source by its factor, and dropping sets under 4 members except those of
    the source that specialises in them. Sets of at most 3 members are never merged."""
    factor = F.coalesce(*[F.when(F.col("src") == s, F.lit(f)) for s, f in factors.items()], F.lit(1.0))
    weighed = scored.where(F.col("score") >= least_score).withColumn("score", F.col("score") * factor).join(sizes(sets_x), "cid")
    kept = weighed.where((F.col("src") == small_from) | (F.col("size") >= 4) if small_from else F.col("size") >= 4).select("cid", "src", "score")
    return combine(kept, sets_x.join(kept, "cid", "left_semi"), 1, threshold, add, over=3)


def source_histogram(combined: DataFrame) -> DataFrame:
    n = F.size(F.split("sources", ","))
    return combined.groupBy(n.alias("n_sources")).agg(F.count(F.lit(1)).alias("n_sets"))


def size_statistics(sets_x: DataFrame) -> DataFrame:
    return sizes(sets_x).agg(F.count(F.lit(1)).alias("n_sets"), F.avg("size").alias("mean_size"), F.stddev_pop("size").alias("std_size"))


def recombine(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows (term, cid, node): equal sets of different terms become one (the first term's); rescored by weighted density."""
    keyed = rows.groupBy("term", "cid").agg(F.array_join(F.sort_array(F.collect_set("node")), " ").alias("key"))
    first = keyed.groupBy("key").agg(F.min("term").alias("term"))
    kept = keyed.join(first, ["key", "term"]).select("term", "cid")
    sets = rows.join(kept, ["term", "cid"], "left_semi").select(F.concat_ws("/", "term", "cid").alias("cid"), "node")
    return weighted_density(sets, edges)


def hub_members(sets_x: DataFrame, hubs: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """(cid, node, connectivity) of hubs whose mean weight to a set's members reaches the threshold, all judged against the sets as they were."""
    ends = edges.select(F.col("u").alias("hub"), F.col("v").alias("node"), "w").unionByName(edges.select(F.col("v").alias("hub"), F.col("u").alias("node"), "w"))
    linked = ends.join(hubs.select(F.col("node").alias("hub")), "hub", "left_semi").join(sets_x, "node")
    mean = linked.groupBy("cid", "hub").agg(F.sum("w").alias("w")).join(sizes(sets_x), "cid").withColumn("connectivity", F.col("w") / F.col("size"))
    inside = sets_x.select("cid", F.col("node").alias("hub"))
    return mean.where(F.col("connectivity") >= threshold).join(inside, ["cid", "hub"], "left_anti").select("cid", F.col("hub").alias("node"), "connectivity")


def readd_hubs(sets_x: DataFrame, hubs: DataFrame, edges: DataFrame, threshold: float) -> DataFrame:
    """The sets with the hubs of hub_members added."""
    return sets_x.select("cid", "node").unionByName(hub_members(sets_x, hubs, edges, threshold).select("cid", "node"))


def readd_scored(scored: DataFrame, sets_x: DataFrame, hubs: DataFrame, edges: DataFrame, topo: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Sets and scores after giving hubs back by a second, topological weight: a hub joins where its mean `topo` weight to the set's first
    members, over edges that are there, reaches the threshold. In order of falling mean edge weight, each hub that joins adds that mean, taken over the first members, as
    the weight of its pairs with those in the set by then: the score becomes the mean over the pairs of the larger set."""
    members = sizes(sets_x)
    there = topo.join(edges.select("u", "v"), ["u", "v"], "left_semi").select("u", "v", "w")
    allowed = hub_members(sets_x, hubs, there, threshold).select("cid", "node")
    joining = allowed.join(hub_members(sets_x, hubs, edges, float("-inf")), ["cid", "node"])
    # a hub that joins as the k-th brings the weight c * (n + k - 1) of the pairs that it adds
    order = Window.partitionBy("cid").orderBy(F.desc("connectivity"), "node")
    placed = joining.join(members, "cid").withColumn("k", F.row_number().over(order))
    added = placed.groupBy("cid", "size").agg(F.sum(F.col("connectivity") * (F.col("size") + F.col("k") - 1)).alias("w"), F.max("k").alias("k"))
    n, m = F.col("size"), F.col("size") + F.col("k")
    score = F.when(F.col("k").isNull(), F.col("score")).otherwise((F.col("score") * n * (n - 1) / 2 + F.col("w")) / (m * (m - 1) / 2))
    rescored = scored.join(added, "cid", "left").select("cid", score.alias("score"))
    return sets_x.select("cid", "node").unionByName(allowed), rescored


def return_hubs(sets_x: DataFrame, hubs: DataFrame, weights: DataFrame, net: DataFrame, threshold: float = 0.3) -> DataFrame:
    """cid, node, score after giving hubs back in order of falling degree: a hub joins where its summed weight to the members, over the set's
    size at that time, exceeds the threshold, so hubs that joined before it count. Sets under two members or with score 0 go.

    The fold runs per set inside one aggregate: the hub-to-member and hub-to-hub weights of a set are its only input."""
    ends = weights.select(F.col("u").alias("hub"), F.col("v").alias("other"), "w").unionByName(weights.select(F.col("v").alias("hub"), F.col("u").alias("other"), "w"))
    ends = cut(ends.join(hubs.select(F.col("node").alias("hub"), "degree"), "hub"))
    between = cut(ends.join(hubs.select(F.col("node").alias("other")), "other", "left_semi").select("hub", "other", "w"))
    to_members = cut(ends.join(sets_x.select("cid", F.col("node").alias("other")), "other").groupBy("cid", "hub").agg(F.sum("w").alias("w")))
    # a hub may also join through hubs that joined before it
    cand = new = to_members.select("cid", "hub")
    while True:
        new = new.join(between.select("hub", "other"), "hub").select("cid", F.col("other").alias("hub")).distinct()
        new = cut(new.join(cand, ["cid", "hub"], "left_anti"))
        if new.isEmpty():
            break
        cand = cut(cand.unionByName(new))
    pairs = cand.join(between, "hub").join(cand.select("cid", F.col("hub").alias("other")), ["cid", "other"])
    links = pairs.groupBy("cid", "hub").agg(F.collect_list(F.struct("other", "w")).alias("links"))
    per_hub = cand.join(to_members, ["cid", "hub"], "left").join(links, ["cid", "hub"], "left").join(hubs.select(F.col("node").alias("hub"), "degree"), "hub")
    listed = per_hub.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct((-F.col("degree")).alias("d"), "hub", F.coalesce("w", F.lit(0.0)).alias("w"), "links"))).alias("hubs"))
    joined = sets_x.groupBy("cid").agg(F.collect_set("node").alias("members")).join(listed, "cid", "left")

    def step(acc: Column, h: Column) -> Column:
        earlier = F.filter(h["links"], lambda x: F.array_contains(acc, x["other"]) & ~F.array_contains(F.col("members"), x["other"]))
        total = h["w"] + F.aggregate(F.coalesce(earlier, F.array().cast("array<struct<other:string,w:double>>")), F.lit(0.0), lambda s, x: s + x["w"])
        return F.when(~F.array_contains(acc, h["hub"]) & (total / F.size(acc) > threshold), F.array_append(acc, h["hub"])).otherwise(acc)

    grown = joined.select("cid", F.coalesce(F.aggregate("hubs", F.col("members"), step), F.col("members")).alias("members"))
    out_x = cut(grown.select("cid", F.explode("members").alias("node")))
    scores = weighted_density(out_x, net, doubled=True).where("size >= 2 and score > 0")
    return out_x.join(scores.select("cid", "score"), "cid")


def for_evaluation(scored: DataFrame, sets_x: DataFrame, least_size: int = 0, small_only: bool | None = None, least_score: float | None = None, unique_at: float | None = None, top: int | None = None) -> DataFrame:
    """scored(cid, score) cut down: by size class (small_only: sizes 2 and 3, or 4 and more), least size, least score, greedy
    uniqueness in score order, and the top n."""
    out = scored.select("cid", "score").join(sizes(sets_x), "cid").where(F.col("size") >= least_size)
    if small_only is not None:
        out = out.where(F.col("size").between(2, 3) if small_only else F.col("size") >= 4)
    if least_score is not None:
        out = out.where(F.col("score") >= least_score)
    if unique_at is not None:
        out = dedup(cut(out), sets_x.join(out, "cid", "left_semi"), unique_at, by_score=True, aware=False)
    return out.orderBy(F.desc("score"), "cid").limit(top) if top else out
