"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

The mix takes 150 % of all words. Sources share it by weight; a source never gives more than `repeat` times its words,
and what it leaves is shared again by weight among the others. Within a source a document's expected copies are in proportion to
its own weight, stopped at `repeat`; what the stopped ones leave is shared again among the others, until the expected words are the
target. The own weight is a column's, or else the binary length of the document's size: twice the words, one step more. Its whole
copies are certain; the fraction pi that remains is its inclusion probability. With u from the id, a document's rank is
(u / (1 - u)) / (pi / (1 - pi)), and the sample of a source is its lowest ranks, as many as bring its words next to the target.

The cut in the ranks is found digit by digit: a rank becomes RADIX**LEVELS steps, each level sums words by (source,
digit) within the step that holds the cut, and only documents of the last step are put in order. No task ever
holds more than that and no source is gathered, however large.

Defined cases: null or empty text has size 0 and takes 0; a null source is one source, ordered last; a source with no words
has target 0; ties in rank go by id, then size (rows equal in both are interchangeable, and each counts); a null id draws by the text's
digest instead; a null, negative or NaN weight is 0; if all weights of a source are 0 or stopped, it falls short of its target; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsets.llm.common import WORD, cut, text_of

WEIGHTS = (5, 2, 1)
RADIX = 256
LEVELS = 3


def uniform(key: Column) -> Column:
    """In (0, 1), from the first 12 hex digits of the key's MD5: 48 bits, the same on every run."""
    bits = F.conv(F.substring(F.md5(key.cast("string")), 1, 12), 16, 10).cast("long")
    return (bits + 0.5) / F.lit(float(1 << 48))


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, repeat: int) -> DataFrame:
    """source, source_size, source_docs, target: one row per source.

    Sharing the excess again until none is above its stop ends at min(weight * level, stop) with one common level. In the
    order of stop / weight the full sources come first, so running sums give that level; the rows are sources, never documents.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weigh = F.element_at(F.array(*[F.lit(w) for w in weights]), ((order - 1) % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weigh).withColumn("stop", F.col("source_size") * repeat)
    everything = Window.partitionBy()
    by_stop = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything)
    left_words = total * F.lit(share) - F.coalesce(F.sum("stop").over(before), F.lit(0))
    left_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    # the level that would hold were this source and all after it below their stops; the first such source sets it
    sources = sources.withColumn("level", left_words / left_weight)
    is_open = F.col("stop") > F.col("weight") * F.col("level")
    level = F.first(F.when(is_open, F.col("level")), ignorenulls=True).over(by_stop.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    fair = F.col("weight") * F.col("common")
    return sources.withColumn("common", level).select(
        "source",
        "source_size",
        F.when(F.col("common").isNull() | (fair >= F.col("stop")), F.col("stop").cast("double")).otherwise(fair.cast("double")).alias("target"),
    )


def shares(sized: DataFrame, targets: DataFrame, repeat: int) -> DataFrame:
    """source, rate: a document's expected copies are least(repeat, rate * own), and their words then add up to the source's target.

    Documents that the rate at hand stops count with `repeat`, and the others share what these leave, at a higher rate. A round is one
    sum a source over the distinct weights; the rounds end when none stops another document, which is after a few.
    """
    live = cut(sized.where("own > 0 and size > 0").groupBy("source", "own").agg(F.sum("size").alias("size")))
    rates = targets.select("source", "target", F.lit(0.0).alias("rate"), F.lit(-1).cast("long").alias("n_stopped"))
    while True:
        stopped = F.col("rate") * F.col("own") >= repeat
        sums = live.alias("d").join(rates.alias("r"), F.expr("d.source <=> r.source")).groupBy("r.source", "target", "rate", "n_stopped").agg(
            F.sum(F.when(stopped, F.col("size")).otherwise(0)).alias("full"),
            F.sum(F.when(stopped, 0.0).otherwise(F.col("size") * F.col("own"))).alias("pull"),
            F.sum(stopped.cast("long")).alias("now_stopped"),
        )
        shared = (F.col("target") - repeat * F.col("full")) / F.col("pull")
        moved = F.col("now_stopped") > F.col("n_stopped")
        rates = cut(sums.select("source", "target", F.when(moved & (F.col("pull") > 0), shared).otherwise(F.col("rate")).alias("rate"), "now_stopped", moved.alias("moved")))
        if rates.where("moved").isEmpty():
            return rates.select("source", "rate")
        rates = rates.select("source", "target", "rate", F.col("now_stopped").alias("n_stopped"))


def _taken(scored: DataFrame) -> DataFrame:
    """Rows with whole, size, rank digits -> the same with `drawn`: 1 where the sample has the row."""
    held = F.col("pi") > 0
    live = scored.where(held & (F.col("size") > 0))
    # state of each source: the digits settled so far and the words still to take
    state = scored.groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("whole") * F.col("size")).alias("certain"))
    state = state.select("source", (F.col("target") - F.col("certain")).alias("need"), F.array().cast("array<int>").alias("cut"))
    for level in range(LEVELS):
        here = live.alias("d").join(state.alias("s"), F.expr("d.source <=> s.source")).where(
            F.slice("digits", 1, level) == F.col("cut") if level else F.lit(True)
        )
        sums = here.groupBy(F.col("d.source").alias("source"), F.element_at("digits", level + 1).alias("digit")).agg(
            F.sum("size").alias("words"), F.first("need").alias("need"), F.first("cut").alias("cut")
        )
        through = F.sum("words").over(Window.partitionBy("source").orderBy("digit"))
        steps = sums.withColumn("before", through - F.col("words"))
        # the cut is in the last step that starts at or below the need; if the need is met, in the first step
        last = F.max_by(F.struct("digit", "before", "need", "cut"), "digit")
        chosen = steps.where("before <= need or before = 0").groupBy("source").agg(last.alias("c"))
        state = cut(chosen.select("source", (F.col("c.need") - F.col("c.before")).alias("need"), F.concat("c.cut", F.array("c.digit")).alias("cut")))
    edge = live.alias("d").join(state.alias("s"), F.expr("d.source <=> s.source")).where("digits = cut")
    ordered = Window.partitionBy(F.col("d.source")).orderBy("digits", "rank", "doc_id", "size")
    through = F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = edge.select("row", F.col("need"), "size", through.alias("through"))
    # a row is drawn if more than half of it lies below the need: the sum then ends next to the target
    drawn_edge = placed.where(F.col("through") - F.col("size") / 2.0 <= F.col("need")).select("row", F.lit(1).alias("edge"))
    joined = scored.alias("d").join(state.alias("s"), F.expr("d.source <=> s.source"), "left").select("d.*", F.col("s.cut").alias("cut"))
    below = held & F.coalesce(F.col("digits") < F.col("cut"), F.lit(False))
    joined = joined.join(drawn_edge, "row", "left")
    return joined.withColumn("drawn", F.when(below, 1).otherwise(F.coalesce("edge", F.lit(0)))).drop("edge", "cut")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight_col: str | None = None,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    repeat: int = 2,
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken (= copies * size)."""
    size = F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")
    given = F.col(weight_col).cast("double") if weight_col else F.lit(0.0)
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        size.alias("size"),
        F.when((given > 0) & ~F.isnan(given), given).otherwise(0.0).alias("given"),
        F.coalesce(F.col(id_col).cast("string"), F.md5(text_of(text_col))).alias("key"),
    )
    own = F.col("given") if weight_col else F.length(F.bin("size")).cast("double")
    sized = cut(sized.withColumn("own", own).drop("given").withColumn("row", F.monotonically_increasing_id()))
    targets = cut(source_targets(sized, weights, share, repeat))
    rates = shares(sized, targets, repeat)
    # both tables have a row per source; Spark broadcasts them only if their measured size allows that
    scored = sized.alias("d").join(targets.alias("t"), F.expr("d.source <=> t.source")).join(rates.alias("r"), F.expr("d.source <=> r.source"), "left")
    copies = F.least(F.coalesce(F.col("r.rate"), F.lit(0.0)) * F.col("d.own"), F.lit(float(repeat)))
    scored = scored.select("d.*", "t.source_size", "t.target", copies.alias("copies"))
    scored = scored.withColumn("whole", F.floor("copies")).withColumn("pi", F.col("copies") - F.col("whole"))
    u = uniform(F.col("key"))
    rank = (u / (1 - u)) / (F.col("pi") / (1 - F.col("pi")))
    scored = scored.withColumn("rank", F.when(F.col("pi") > 0, rank))
    step = F.floor(F.col("rank") / (1 + F.col("rank")) * F.lit(float(RADIX**LEVELS)))
    digits = [(F.shiftright(step, 8 * i) % RADIX).cast("int") for i in reversed(range(LEVELS))]
    scored = scored.withColumn("digits", F.when(F.col("pi") > 0, F.array(*digits)))
    copies = (F.col("whole") + F.col("drawn")).cast("long")
    return _taken(scored).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
