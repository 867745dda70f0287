"""From documents to token shards: toxicity, near-duplicates, benchmark passages, mixing, token output.

Each stage takes what its predecessor kept, read again from Parquet, and returns rows with the same columns; the last one
returns what its files hold. Rows without an id can't be named as copies of another, so near-duplicate removal keeps them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netsets.llm.common import cut, fresh_path, read
from netsets.llm.decontaminate import with_contaminated
from netsets.llm.jaccard import near_copies
from netsets.llm.mixing import mix
from netsets.llm.tokens import token_output
from netsets.llm.toxicity import fit, with_toxicity

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: A name that no table has.
MARK = "__corpus_pipeline_mark"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated score is below a half stay."""
    scored = with_toxicity(docs, fit(docs, read(spark, sf_dir, "labels")), score_col=MARK)
    return scored.where(F.col(MARK) < 0.5).drop(MARK)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; of rows that repeat its id, the first text. SimHash links, confirmed
    by the exact similarity (word shingles of five, Jaccard 0.8 or more), and what lies beyond their radius."""
    found = cut(near_copies(docs).where("doc_id is not null"))
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    repeated = cut(found.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    one = kept.join(repeated, "doc_id", "left_semi").withColumn(MARK, place).where(F.col(MARK) == 1).drop(MARK)
    return kept.join(repeated, "doc_id", "left_anti").unionByName(one).select(docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs stay."""
    return with_contaminated(docs, read(spark, sf_dir, "benchmark"), flag_col=MARK).where(~F.col(MARK)).drop(MARK)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it. Rows that share an id share the copies of them all, as evenly as can be."""
    copies = mix(docs).groupBy("doc_id").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    joined = docs.alias("d").join(cut(copies).alias("c"), F.expr("d.doc_id <=> c.doc_id")).select("d.*", F.col("c.copies").alias(MARK), F.col("c.rows").alias(MARK + "_rows"))
    single = joined.where(F.col(MARK + "_rows") == 1)
    shared = joined.where(F.col(MARK + "_rows") > 1)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    n, rows = F.col(MARK), F.col(MARK + "_rows")
    shared = shared.withColumn(MARK, F.floor(n / rows) + (place <= n % rows).cast("long"))
    taken = single.unionByName(shared).where(F.col(MARK) > 0)
    return taken.withColumn(MARK, F.explode(F.sequence(F.lit(1).cast("long"), F.col(MARK)))).select(docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in id order, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_output(spark, docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: The learned scores, fingerprints and tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
