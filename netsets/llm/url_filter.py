"""URL filter: stated host and path rules, then a Bloom filter cascade over the corpus's complete key universe.

Keys are hosts and their parent domains. Level 1 encodes the listed keys that the corpus has; the other keys it lets through are
all known, and level 2 encodes them; level 3 encodes the listed keys that level 2 lets through; and so on until a level lets none
through. For every key of the corpus the first level that refuses it tells whether it is listed, without error and without
a join: only the filters, whose size is bounded by MAX_FILTER_BYTES, are broadcast. A list beyond that is split by key hash
into as many cascades as needed, each read in a pass of its own.

Defined cases: a null url, or one without `://`, has empty host and path, fits no rule and is allowed; null listed keys are
ignored; an empty list allows all that no rule blocks; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsets.llm.common import cut

BITS_MIN = 64
MAX_FILTER_BYTES = 64 << 20
MAX_LEVELS = 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: str) -> tuple[Column, Column]:
    """Host and path of a url column, as the contract states them."""
    text = F.coalesce(F.col(url), F.lit(""))
    at = F.locate("://", text)
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule; rules are ('host/path', 'block' or 'allow')."""
    rule, verdict = None, None
    for text, said in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        domain, _, below = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + below)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(said)) if verdict is None else verdict.when(fits, F.lit(said))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    """Another 64-bit hash of the same key for each level."""
    with np.errstate(over="ignore"):
        z = h + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def positions(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    """keys x hashes bit numbers, by double hashing."""
    a, b = _mixed(h1.view(np.uint64), level) % np.uint64(bits), _mixed(h2.view(np.uint64), level) % np.uint64(bits)
    return ((a[:, None] + b[:, None] * np.arange(hashes, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


@dataclass
class Level:
    bits: int
    hashes: int
    words: np.ndarray  # uint64

    def lets_through(self, h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
        at = positions(h1, h2, level, self.bits, self.hashes)
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Level n refuses a key: it is listed if n is even (levels from 1), else not. None refuses it: as the last level says."""
        out = np.zeros(len(h1), bool)
        inside = np.arange(len(h1))
        for n, level in enumerate(self.levels, 1):
            passed = level.lets_through(h1[inside], h2[inside], n)
            out[inside[~passed]] = n % 2 == 0
            inside = inside[passed]
        out[inside] = len(self.levels) % 2 == 1
        return out

    def size(self) -> int:
        return sum(level.words.nbytes for level in self.levels)


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(F.lit(1), key).alias("h1"), F.xxhash64(F.lit(2), key).alias("h2")]


def _level(keys: DataFrame, count: int, rate: float, number: int) -> Level:
    """A filter of the keys' hashes: tasks emit the words that they set, one row a word, and these are or-ed together."""
    hashes = max(1, round(-np.log2(rate)))
    bits = max(BITS_MIN, int(-(-count * hashes * 1.4427 // 64) * 64))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            at = np.unique(positions(h1, h2, number, bits, hashes))
            word, first = np.unique(at >> 6, return_index=True)
            if len(word):
                mask = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask.view(np.int64))], names=["word", "mask"])

    table = keys.select("h1", "h2").mapInArrow(words, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    out = np.zeros(bits // 64, np.uint64)
    # at most bits / 64 rows, bounded by MAX_FILTER_BYTES
    rows = table.toArrow()
    out[rows["word"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
    return Level(bits, hashes, out)


def build_cascades(universe: DataFrame, listed: DataFrame) -> list[Cascade]:
    """universe (key), listed (key): one cascade, or as many as keep each within MAX_FILTER_BYTES; cascade i holds keys with pmod(h1, n) = i."""
    mark = listed.where("key is not null").select("key", F.lit(True).alias("in_list")).distinct()
    keys = universe.where("key is not null").distinct().join(mark, "key", "left")
    keys = cut(keys.select(*_hashes(F.col("key")), F.coalesce("in_list", F.lit(False)).alias("in_list")))
    sizes = {r.in_list: r["count"] for r in keys.groupBy("in_list").count().collect()}
    n_in, n_out = sizes.get(True, 0), sizes.get(False, 0)
    rate = min(0.5, max(n_in, 1) / max(n_out, 1))
    total_bits = 1.4427 * (n_in * max(1, -np.log2(rate)) + 4 * n_in)
    shards = max(1, int(-(-total_bits // (8 * MAX_FILTER_BYTES))))
    out = []
    for shard in range(shards):
        own = keys.where(F.pmod("h1", F.lit(shards)) == shard)
        cascade, into, against = Cascade(), own.where("in_list"), own.where("not in_list")
        count = into.count()
        while count:
            number = len(cascade.levels) + 1
            if number > MAX_LEVELS:
                raise ValueError("keys with equal hashes on both sides of the list")
            level = _level(into, count, rate if number == 1 else 0.5, number)
            cascade.levels.append(level)
            through = cut(_through(against, level, number))
            into, against, count = through, into, through.count()
        out.append(cascade)
    return out


def _through(keys: DataFrame, level: Level, number: int) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    @F.pandas_udf("boolean")
    def through(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(shared.value.lets_through(h1.to_numpy(np.int64), h2.to_numpy(np.int64), number))

    return keys.where(through("h1", "h2"))


def _suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", key_col: str = "key") -> DataFrame:
    """One row per page: page_id, host, path, rule, listed, verdict."""
    host, path = url_parts(url_col)
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    universe = parts.select("host").distinct().select(F.explode(_suffixes(F.col("host"))).alias("key"))
    cascades = build_cascades(universe, listed.select(F.col(key_col).alias("key")))
    rows = parts.withColumn("keys", F.transform(_suffixes(F.col("host")), lambda k: F.struct(*_hashes(k))))
    rows = rows.select("*", F.col("keys.h1").alias("h1"), F.col("keys.h2").alias("h2")).withColumn("listed", F.lit(False))
    for shard, cascade in enumerate(cascades):
        rows = rows.withColumn("listed", F.col("listed") | _any_listed(rows, cascade, shard, len(cascades))("h1", "h2"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(said, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return rows.select("page_id", "host", "path", rule.alias("rule"), "listed", verdict.alias("verdict"))


def _any_listed(rows: DataFrame, cascade: Cascade, shard: int, shards: int):
    shared = rows.sparkSession.sparkContext.broadcast(cascade)

    @F.pandas_udf("boolean")
    def listed(h1: pd.Series, h2: pd.Series) -> pd.Series:
        if not len(h1):
            return pd.Series([], dtype=bool)
        first = np.r_[0, np.cumsum(h1.map(len).to_numpy())[:-1]]
        a, b = np.concatenate(h1.to_numpy()).astype(np.int64), np.concatenate(h2.to_numpy()).astype(np.int64)
        found = shared.value.listed(a, b) & (a % shards == shard)
        return pd.Series(np.logical_or.reduceat(found, first))

    return listed
