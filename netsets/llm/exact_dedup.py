"""Exact deduplication by content sort, in DataFrame operations only.

Every row gets the order key (leading bytes, digest, text, id). A bounded sample of keys gives splitters; a row's
bucket is found by binary search among them, one exchange by bucket and an external sort put equal texts side by
side, and each row is compared in full with its neighbour. Splitters hold the id too, so a text that fills a third
of the table is dealt over many buckets; the runs that touch a bucket's edge (two per bucket) are chained afterwards:
a join of each bucket's last text with the first of the next compares them in full, spread over all tasks.

Defined cases: null text counts as empty (after `normalise`); equal texts form one group whatever their ids; a null
id sorts below every other, so it stays only where all ids of its group are null; of repeated (id, text) rows one
stays; an empty table gives an empty result; columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsets.llm.common import cut, text_of

#: Bytes of a text that lead its order key; the digest orders what they leave equal.
LEAD_BYTES = 24
#: Buckets per shuffle partition, sampled keys per bucket, and the most sampled keys: bounds of what the driver sees. Splitters decide
#: only how evenly rows are dealt, never the result.
BUCKETS_PER_PARTITION = 4
SAMPLES_PER_BUCKET = 30
MOST_SAMPLES = 1_000_000


def _keyed(docs: DataFrame, id_col: str, text_col: str, normalise: Callable[[Column], Column]) -> DataFrame:
    thin = docs.select(F.col(id_col).cast("long").alias("id"), normalise(text_of(text_col)).alias("t"))
    raw = F.encode("t", "UTF-8")
    digest = F.sha2(raw, 256)
    lead = F.hex(F.substring(raw, 1, LEAD_BYTES))
    return thin.select("id", "t", digest.alias("sha"), F.concat_ws(".", lead, digest).alias("k"))


def _splitters(docs: DataFrame, keyed: Callable[[DataFrame], DataFrame], buckets: int) -> list[dict]:
    """At most buckets - 1 keys, from a sample whose expected size is a fixed multiple of the buckets."""
    rows = docs.count()
    if not rows:
        return []
    samples = min(SAMPLES_PER_BUCKET * buckets, MOST_SAMPLES)
    drawn = keyed(docs.sample(False, min(1.0, samples / rows), seed=42)).select("k", "id").limit(2 * samples).collect()
    drawn = sorted({(r.k, r.id is not None, r.id or 0) for r in drawn})
    picked = drawn[:: max(1, -(-len(drawn) // buckets))][1:]
    return [{"k": k, "id": i if there else None} for k, there, i in picked]


def _bucket(splitters: list[dict]) -> Column:
    """Splitters at or below the row's key, by binary search over a literal array: log2(buckets) comparisons."""
    if not splitters:
        return F.lit(0)
    table = F.from_json(F.lit(json.dumps(splitters)), "array<struct<k:string,id:bigint>>")
    steps = [1 << i for i in reversed(range(len(splitters).bit_length()))]
    key = F.struct(F.col("k").alias("k"), F.col("id").alias("id"))
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when(F.get(table, at + step - 1) <= key, at + step).otherwise(at),
    )


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = lambda c: c,
    keep: str = "smallest",
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256. `keep`: smallest or largest id of a group."""
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep!r}")
    spark = docs.sparkSession
    best = F.max if keep == "largest" else F.min
    buckets = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = lambda df: _keyed(df, id_col, text_col, normalise)
    sorted_by = Window.partitionBy("b").orderBy("k", "t", "id")
    rows = keyed(docs).withColumn("b", _bucket(_splitters(docs, keyed, buckets)))
    beside = rows.select(
        "b",
        "id",
        "sha",
        (~F.lag("t").over(sorted_by).eqNullSafe(F.col("t"))).cast("int").alias("new"),
        F.lag("k").over(sorted_by).isNull().alias("first"),
        F.lead("k").over(sorted_by).isNull().alias("last"),
        "t",
    )
    # only the two edge rows of a bucket keep their text
    thin = beside.select(
        "b",
        "id",
        "sha",
        "new",
        F.when(F.col("first"), F.col("t")).alias("first_t"),
        F.when(F.col("last"), F.col("t")).alias("last_t"),
        F.monotonically_increasing_id().alias("at"),
    )
    runs = thin.withColumn("run", F.sum("new").over(Window.partitionBy("b").orderBy("at")))
    of_run, in_run = Window.partitionBy("b", "run"), Window.partitionBy("b", "run").orderBy("at")
    runs = cut(
        runs.select(
            "b",
            "run",
            "id",
            "sha",
            "first_t",
            "last_t",
            F.count(F.lit(1)).over(of_run).alias("n"),
            best("id").over(of_run).alias("best"),
            (F.lead("at").over(in_run).isNull() | ~F.lead("id").over(in_run).eqNullSafe(F.col("id"))).alias("single"),
        )
    )
    # at most two rows a bucket, and the number of buckets is fixed by the settings
    merged = runs.join(F.broadcast(_chained(runs, best)), ["b", "run"], "left")
    keep_id = F.when(F.col("chain_n").isNull(), F.col("best")).otherwise(F.col("chain_best"))
    return merged.select(
        F.col("id").alias("doc_id"),
        keep_id.alias("keep_id"),
        F.coalesce("chain_n", "n").alias("group_size"),
        (F.col("id").eqNullSafe(keep_id) & F.col("single")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def _chained(runs: DataFrame, best: Callable[[str], Column]) -> DataFrame:
    """For the edge runs of every bucket, size and kept id over the runs that continue across buckets: at most two thin rows a bucket.

    Every bucket but the first holds the row that its splitter was drawn from, so a run goes on in the very next bucket or ends. Where the
    last text of a bucket and the first of the next have one digest they are compared in full; runs of one digest are then one text.
    """
    edges = runs.where("first_t is not null or last_t is not null")
    heads = edges.where("first_t is not null").select(F.col("b"), "sha", F.col("first_t").alias("t"))
    tails = edges.where("last_t is not null").select((F.col("b") + 1).alias("b"), "sha", F.col("last_t").alias("u"))
    different = F.raise_error(F.lit("two different texts have one SHA-256 digest"))
    met = heads.join(tails, ["b", "sha"]).select("sha", F.when(F.col("t") == F.col("u"), F.lit(True)).otherwise(different).alias("same"))
    goes_on = met.where("same").select("sha").distinct()
    pieces = edges.groupBy("b", "run").agg(F.first("sha").alias("sha"), F.first("n").alias("n"), F.first("best").alias("best"))
    pieces = cut(pieces.join(goes_on, "sha", "left_semi"))
    whole = pieces.groupBy("sha").agg(F.sum("n").alias("chain_n"), best("best").alias("chain_best"))
    return pieces.join(whole, "sha").select("b", "run", "chain_n", "chain_best")
