"""Evaluation of predicted sets against reference sets; preds_x, refs_x (cid, node), scored (cid, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsets.functions.sets import bader, f2_score, f_score, jaccard, size_aware_match
from netsets.operators.clusters import overlaps, sizes
from netsets.operators.running import running
from netsets.plans.lineage import cut, small


def _score(f):
    return f(F.col("both"), F.col("na"), F.col("nb"))


def _count(sets_x: DataFrame, name: str) -> DataFrame:
    return sets_x.agg(F.countDistinct("cid").alias(name))


def precision_recall(preds_x: DataFrame, refs_x: DataFrame, threshold: float = 0.5) -> DataFrame:
    """n_preds, n_refs, precision, recall, f1, f2: shares of sets with some Jaccard index at the threshold. One row."""
    hits = overlaps(preds_x, refs_x).where(_score(jaccard) >= threshold)
    found = hits.agg(F.countDistinct("a").alias("hit_preds"), F.countDistinct("b").alias("hit_refs"))
    one = found.join(F.broadcast(_count(preds_x, "n_preds"))).join(F.broadcast(_count(refs_x, "n_refs")))
    p = F.when(F.col("n_preds") > 0, F.col("hit_preds") / F.col("n_preds")).otherwise(F.lit(0.0))
    r = F.when(F.col("n_refs") > 0, F.col("hit_refs") / F.col("n_refs")).otherwise(F.lit(0.0))
    rated = one.select("n_preds", "n_refs", p.alias("precision"), r.alias("recall"))
    return rated.select("*", f_score(F.col("precision"), F.col("recall")).alias("f1"), f2_score(F.col("precision"), F.col("recall")).alias("f2"))


def _accumulated(step: float = 0.01, n: int = 110) -> list[float]:
    """step, step + step, ...: added up one by one, as the published curve does."""
    out, x = [], 0.0
    for _ in range(n):
        x += step
        out.append(x)
    return out


def pr_curve(scored: DataFrame, preds_x: DataFrame, refs_x: DataFrame, threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """threshold, n_preds, precision, recall (per `by`): one point for each distinct score at which recall enters a new 0.01 step, and the last.

    Predictions in falling score order are correct if they match a reference (size-aware). A reference counts from its first match on.
    """
    by = by or []
    pairs = overlaps(preds_x, refs_x).where(_score(size_aware_match) >= threshold).select(F.col("a").alias("cid"), F.col("b").alias("ref"))
    hits = pairs.join(scored.select("cid", "score", *by), "cid")
    first = hits.groupBy(*by, "ref").agg(F.max("score").alias("score")).groupBy(*by, "score").agg(F.count(F.lit(1)).alias("new_refs"))
    correct = hits.select(*by, "cid", "score").distinct().groupBy(*by, "score").agg(F.count(F.lit(1)).alias("new_correct"))
    steps = scored.groupBy(*by, "score").agg(F.count(F.lit(1)).alias("new_preds"))
    steps = steps.join(first, [*by, "score"], "left").join(correct, [*by, "score"], "left").na.fill(0, ["new_refs", "new_correct"])
    return _points(steps, _count(refs_x, "n_refs"), by)


def _points(steps: DataFrame, n_refs: DataFrame, by: list[str]) -> DataFrame:
    """steps (score, new_preds, new_refs, new_correct), a row per distinct score -> the recorded points of the curve."""
    whole = cut(steps.groupBy(*by).agg(F.sum("new_preds").alias("all_preds")))
    run = running(steps, by, "score", STEPS).join(F.broadcast(n_refs))
    run = run.join(small(whole), by) if by else run.join(F.broadcast(whole))
    edges = F.array(*[F.lit(x) for x in _accumulated()])
    bucket = lambda refs: F.size(F.filter(edges, lambda e: e <= refs / F.col("n_refs")))
    # recall never falls, so the highest step before is that of the point before
    enters = bucket(F.col("through_new_refs")) > bucket(F.col("through_new_refs") - F.col("new_refs"))
    kept = run.where(enters | (F.col("through_new_preds") == F.col("all_preds")))
    precision, recall = F.col("through_new_correct") / F.col("through_new_preds"), F.col("through_new_refs") / F.col("n_refs")
    return kept.select(*by, F.col("score").alias("threshold"), F.col("through_new_preds").alias("n_preds"), precision.alias("precision"), recall.alias("recall"))


def auc_pr(scored: DataFrame, preds_x: DataFrame, refs_x: DataFrame, threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """auc (per `by`): sum of recall gain times precision over the points of pr_curve."""
    by = by or []
    order = Window.partitionBy(*by).orderBy(F.desc("threshold"))
    gain = (F.col("recall") - F.coalesce(F.lag("recall").over(order), F.lit(0.0))) * F.col("precision")
    points = pr_curve(scored, preds_x, refs_x, threshold, by).withColumn("gain", gain)
    return points.groupBy(*by).agg(F.sum("gain").alias("auc"))


def sensitivity(preds_x: DataFrame, refs_x: DataFrame) -> DataFrame:
    best = overlaps(preds_x, refs_x).groupBy("b").agg(F.max("both").alias("best")).agg(F.sum("best").alias("top"))
    whole = sizes(refs_x).agg(F.sum("size").alias("whole"))
    return best.join(F.broadcast(whole)).select((F.coalesce("top", F.lit(0)) / F.col("whole")).alias("sensitivity"))


def predictive_value(preds_x: DataFrame, refs_x: DataFrame) -> DataFrame:
    per = overlaps(preds_x, refs_x).groupBy("a").agg(F.max("both").alias("best"), F.sum("both").alias("whole"))
    return per.agg((F.sum("best") / F.sum("whole")).alias("ppv"))


def accuracy(preds_x: DataFrame, refs_x: DataFrame) -> DataFrame:
    both = sensitivity(preds_x, refs_x).join(F.broadcast(predictive_value(preds_x, refs_x)))
    return both.select("sensitivity", "ppv", F.sqrt(F.col("sensitivity") * F.col("ppv")).alias("accuracy"))


def fraction_matched(preds_x: DataFrame, refs_x: DataFrame, threshold: float = 0.25) -> DataFrame:
    hit = overlaps(preds_x, refs_x).where(_score(bader) > threshold).agg(F.countDistinct("b").alias("n"))
    return hit.join(F.broadcast(_count(refs_x, "n_refs"))).select((F.col("n") / F.col("n_refs")).alias("fraction_matched"))


def separation(preds_x: DataFrame, refs_x: DataFrame) -> DataFrame:
    """Square root of the mean over references times the mean over predictions of the summed products of row and column shares."""
    cells = overlaps(preds_x, refs_x)
    row, col = F.sum("both").over(Window.partitionBy("b")), F.sum("both").over(Window.partitionBy("a"))
    total = cells.select((F.col("both") * F.col("both") / (row * col)).alias("x")).agg(F.sum("x").alias("x"))
    counts = _count(preds_x, "n_preds").join(F.broadcast(_count(refs_x, "n_refs")))
    x = F.coalesce("x", F.lit(0.0))
    return total.join(F.broadcast(counts)).select(F.sqrt((x / F.col("n_refs")) * (x / F.col("n_preds"))).alias("separation"))


def mean_and_error(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, mean, error of a metric over iterations."""
    n = F.count(value)
    return rows.groupBy(*(by or [])).agg(n.alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(n)).alias("error"))


def cross_validated(scored: DataFrame, preds_x: DataFrame, refs_x: DataFrame, xval: DataFrame, threshold: float = 0.5) -> DataFrame:
    """iteration, threshold, n_preds, precision, recall: predictions are judged by the iteration's test references (xval: iteration, cid);
    those that match training references only are left out of it. scored may have a column `iteration`; else all meet every one."""
    steps = _xval_steps(scored, preds_x, refs_x, xval, threshold)
    n_refs = xval.groupBy("iteration").agg(F.count(F.lit(1)).alias("n_refs"))
    return _curve(running(steps, ["iteration"], "score", STEPS).join(small(n_refs), "iteration"), ["iteration"])


def _xval_steps(scored: DataFrame, preds_x: DataFrame, refs_x: DataFrame, xval: DataFrame, threshold: float) -> DataFrame:
    """iteration, score, new_preds, new_correct, new_refs: a row per distinct score."""
    pairs = overlaps(preds_x, refs_x).where(_score(size_aware_match) >= threshold).select(F.col("a").alias("cid"), F.col("b").alias("ref"))
    turns = xval.select("iteration").distinct()
    base = scored if "iteration" in scored.columns else scored.crossJoin(small(turns))
    base = base.select("iteration", "cid", "score")
    test = xval.select("iteration", F.col("cid").alias("ref"))
    hits = pairs.join(test, "ref").join(base, ["iteration", "cid"]).select("iteration", "cid", "ref", "score")
    good = hits.select("iteration", "cid").distinct()
    any_match = pairs.select("cid").distinct()
    judged = base.join(good.withColumn("ok", F.lit(1)), ["iteration", "cid"], "left").join(any_match.withColumn("some", F.lit(1)), "cid", "left")
    judged = judged.where("ok = 1 or some is null")
    steps = judged.groupBy("iteration", "score").agg(F.count(F.lit(1)).alias("new_preds"), F.count("ok").alias("new_correct"))
    first = hits.groupBy("iteration", "ref").agg(F.max("score").alias("score")).groupBy("iteration", "score").agg(F.count(F.lit(1)).alias("new_refs"))
    return steps.join(first, ["iteration", "score"], "left").na.fill(0, ["new_refs"])


def pooled_cross_validated(scored: DataFrame, preds_x: DataFrame, refs_x: DataFrame, xval: DataFrame, threshold: float = 0.5) -> DataFrame:
    """threshold, n_preds, precision, recall of all iterations in one list: a reference counts once for each iteration that tests it."""
    steps = _xval_steps(scored, preds_x, refs_x, xval, threshold)
    steps = steps.groupBy("score").agg(*[F.sum(c).alias(c) for c in ("new_preds", "new_correct", "new_refs")])
    return _curve(running(steps, [], "score", STEPS).join(F.broadcast(xval.agg(F.count(F.lit(1)).alias("n_refs")))), [])


#: What a distinct score adds to a curve.
STEPS = ["new_preds", "new_correct", "new_refs"]


def _curve(run: DataFrame, by: list[str]) -> DataFrame:
    preds, correct, refs = (F.col(f"through_{c}") for c in STEPS)
    return run.select(*by, F.col("score").alias("threshold"), preds.alias("n_preds"), (correct / preds).alias("precision"), (refs / F.col("n_refs")).alias("recall"))


def reference_match_rate(preds_x: DataFrame, refs_x: DataFrame, xval: DataFrame, threshold: float = 0.5) -> DataFrame:
    """cid, n_tested, n_matched, rate of each reference over the iterations that test it."""
    hit = overlaps(preds_x, refs_x).where(_score(size_aware_match) >= threshold).select(F.col("b").alias("cid")).distinct()
    tested = xval.groupBy("cid").agg(F.count(F.lit(1)).alias("n_tested"))
    out = tested.join(hit.withColumn("hit", F.lit(1)), "cid", "left").withColumn("n_matched", F.when(F.col("hit") == 1, F.col("n_tested")).otherwise(F.lit(0)))
    return out.select("cid", "n_tested", "n_matched", (F.col("n_matched") / F.col("n_tested")).alias("rate"))


def edge_curve(scored_edges: DataFrame) -> DataFrame:
    """scored_edges(score, positive boolean) -> auc_pr, auc_roc over distinct scores: trapezoids in the false positive rate, steps in recall."""
    positive = F.col("positive").cast("long")
    steps = scored_edges.groupBy("score").agg(F.sum(positive).alias("tp"), F.sum(1 - positive).alias("fp"))
    whole = cut(steps.agg(F.sum("tp").alias("pos"), F.sum("fp").alias("neg")))
    run = running(steps, [], "score", ["tp", "fp"]).join(F.broadcast(whole))
    tp, fp = F.col("through_tp"), F.col("through_fp")
    pos, neg = (F.nullif(F.col(c), F.lit(0)) for c in ("pos", "neg"))
    pr = F.col("tp") / pos * tp / (tp + fp)
    roc = F.col("fp") / neg * (tp + tp - F.col("tp")) / pos / 2
    return run.agg(F.sum(pr).alias("auc_pr"), F.sum(roc).alias("auc_roc"))


def roll_up(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Means of all numeric columns per group."""
    numeric = [c for c, kind in metrics.dtypes if kind in ("int", "bigint", "double", "float") and c not in by]
    return metrics.groupBy(*by).agg(*[F.avg(c).alias(c) for c in numeric])
