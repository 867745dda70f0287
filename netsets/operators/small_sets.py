"""Sets of two and three nodes from edge scores: an edge's chance to be a pair of its own, a triangle's to be a triple of its own.

pairs(u, v, w) are the scores; proven(u, v) the edges with direct evidence: only over them do outside edges and common neighbours count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsets.operators.graph import common_neighbours, triangles
from netsets.plans.lineage import cut

LEAST = 1e-8


def _proven(scored: DataFrame, proven: DataFrame | None) -> DataFrame:
    return scored if proven is None else scored.join(proven.select("u", "v").distinct(), ["u", "v"], "left_semi")


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("u", "v")).alias("node"), "w").groupBy("node").agg(F.sum("w").alias("sum"))


def _common(t: DataFrame) -> DataFrame:
    """u, v, x, px: each edge's common neighbours x with the product of their edge scores. From triangles, each once."""
    cases = [F.struct(F.col(p).alias("u"), F.col(q).alias("v"), F.col(x).alias("x"), (F.col(wp) * F.col(wq)).alias("px")) for p, q, x, wp, wq in (("a", "b", "c", "wac", "wbc"), ("a", "c", "b", "wab", "wbc"), ("b", "c", "a", "wab", "wac"))]
    return t.select(F.explode(F.array(*cases)).alias("s")).select("s.*")


def pairs_of_two(scored: DataFrame, proven: DataFrame | None = None, large: DataFrame | None = None, cohesion: bool = True, least: float = LEAST) -> DataFrame:
    """u, v, score: s less s times the products over common neighbours, not under 0; with cohesion, times its share in itself plus the
    outside edges. `large` adds the scores of the large class to the outside. The base network of common neighbours is the proven one."""
    base = cut(_proven(scored, proven))
    # an edge that is not proven itself may still have proven common neighbours
    lost = common_neighbours(scored, base).groupBy("u", "v").agg(F.sum(F.col("wu") * F.col("wv")).alias("lost"))
    new = F.greatest(F.lit(0.0), F.col("w") * (1 - F.coalesce("lost", F.lit(0.0))))
    out = scored.join(lost, ["u", "v"], "left").select("u", "v", "w", new.alias("new"))
    if not cohesion:
        return out.where(F.col("new") >= least).select("u", "v", F.col("new").alias("score"))
    for edges in [base] + ([cut(_proven(large, proven))] if large is not None else []):
        e = _ends(edges)
        own = edges.select("u", "v", F.col("w").alias("ow"))
        out = out.join(e.select(F.col("node").alias("u"), F.col("sum").alias("eu")), "u", "left").join(e.select(F.col("node").alias("v"), F.col("sum").alias("ev")), "v", "left").join(own, ["u", "v"], "left")
        ext = F.coalesce("eu", F.lit(0.0)) + F.coalesce("ev", F.lit(0.0)) - 2 * F.coalesce("ow", F.lit(0.0))
        out = out.withColumn("ext", ext + (F.col("ext") if "ext" in out.columns else F.lit(0.0))).drop("eu", "ev", "ow")
    whole = F.col("new") + F.greatest("ext", F.lit(0.0))
    score = F.when(whole > 0, F.col("new") / whole * F.col("new")).otherwise(F.lit(0.0))
    return out.select("u", "v", score.alias("score")).where(F.col("score") >= least)


def sets_of_three(scored: DataFrame, proven: DataFrame | None = None, cohesion: bool = True, least: float = LEAST) -> DataFrame:
    """a, b, c, score: a triangle's edges, each discounted by common neighbours outside the triangle; their mean, with cohesion times
    their sum's share in itself plus the outside edges of its nodes."""
    base = cut(_proven(scored, proven))
    tri = cut(triangles(base))
    lost = cut(_common(tri).groupBy("u", "v").agg(F.sum("px").alias("lost")))
    total = None
    for p, q, w, others in (("a", "b", "wab", "wac wbc"), ("a", "c", "wac", "wab wbc"), ("b", "c", "wbc", "wab wac")):
        x, y = others.split()
        tri = tri.join(lost.select(F.col("u").alias(p), F.col("v").alias(q), F.col("lost").alias("l")), [p, q])
        # the triangle's own third node is no outsider
        kept = F.greatest(F.lit(0.0), F.col(w) * (1 - (F.col("l") - F.col(x) * F.col(y))))
        tri = cut(tri.withColumn(f"n{w}", kept).drop("l"))
        total = F.col(f"n{w}") if total is None else total + F.col(f"n{w}")
    if not cohesion:
        return tri.select("a", "b", "c", (total / 3).alias("score")).where(F.col("score") >= least)
    e = cut(_ends(base))
    for n in "abc":
        tri = tri.join(e.select(F.col("node").alias(n), F.col("sum").alias(f"e{n}")), n)
    ext = F.greatest(F.col("ea") + F.col("eb") + F.col("ec") - 2 * (F.col("wab") + F.col("wac") + F.col("wbc")), F.lit(0.0))
    score = F.when(total + ext > 0, total / (total + ext) * (total / 3)).otherwise(F.lit(0.0))
    return tri.select("a", "b", "c", score.alias("score")).where(F.col("score") >= least)
