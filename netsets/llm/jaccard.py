"""Near copies by word shingles: components of all pairs of texts whose shingle sets have a Jaccard similarity of at least 4/5.

SimHash finds most of them: fingerprints of the shingles, linked within RADIUS by bit-sliced comparison, each link confirmed by the exact
similarity. Fingerprints of two texts of similarity 4/5 differ in ten bits of 64 on average and in up to twenty, further than
any radius that can be searched whole, so what lies beyond is found by shared shingles, and no pair is left to chance: in any one order of
all shingles, two sets that are similar enough share one of their first |x| - ceil(4/5 |x|) + 1 shingles, so texts meet in a bucket for
each of these. Texts that are linked already need no comparison; lengths, places and bitmaps of the sets rule most others out (two sets
differ in at least as many shingles as their bitmaps in bits), and the rest are compared set by set. The order is by hash, with shingles
common in a sample last: the sample changes the cost, never the pairs. Large buckets compare all members with a few roots a round, and
go on only while they hold more than one component, so a large group of near copies costs a row a member; buckets that the sample
shows to be very large are first dealt over several tasks, each with a root of its own. Texts with equal sets are one node throughout.

Defined cases: words are as in `simhash`; a text shorter than a shingle is one shingle; texts without words are equal; null text counts
as empty; rows with the same id are one node; a null id takes part, and its component_id is the smallest id that is not null, or
null; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsets.llm.common import cut, map_batches, returning, small_batches, text_of
from netsets.llm.simhash import COMPARE_AT_ONCE, LOWER, SEED, components, majority, near_links

SHINGLE = 5
#: Least similarity: PART / WHOLE.
PART, WHOLE = 4, 5
#: Differing bits up to which fingerprints are linked before anything else.
RADIUS = 3
#: Buckets up to this size compare all pairs at once; larger ones begin with one root.
SMALL = 8
#: Rows sampled for common shingles, the rows of them that make one common, and how many are kept. Cost only, never results.
SAMPLE_ROWS, COMMON_FROM, MOST_COMMON = 4000, 3, 10_000
#: Thin rows (two numbers, or a number and a digest) that are sent to every task rather than shuffled, after counting them.
BROADCAST_ROWS = 200_000
#: Texts that one task compares with the same text, and rows of one bucket that one task is expected to get in the first round.
SHARE, SHARD_ROWS = 2000, 1000
#: Least bits of a set's bitmap; larger sets have more, two a member at least.
LEAST_BITS = 512
#: Odd multipliers that mix the words of a shingle, and its hash.
MIX, FINISH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def hashes_of(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the text's shingles, repeats included; one of the whole where it has no more words than a shingle."""
    words = text.translate(LOWER).split()
    n = len(words) - shingle + 1
    if n < 2:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    each = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), words), np.uint64, len(words))
    out = each[:n].copy()
    for i in range(1, shingle):
        out *= MIX
        out ^= out >> np.uint64(29)
        out += each[i : i + n]
    out ^= out >> np.uint64(31)
    out *= FINISH
    return out ^ out >> np.uint64(30)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; never empty."""
    return np.unique(hashes_of(text, shingle))


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    if WHOLE * min(len(x), len(y)) < PART * max(len(x), len(y)):
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return (PART + WHOLE) * shared >= PART * (len(x) + len(y))


def _common(docs: DataFrame, shingle: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Hashes of shingles that many rows of a sample have, sorted; and of the very common among them, (hash, shards for its bucket)."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [shingles(x.as_py(), shingle) for x in batch.column(0).cast(pa.binary())]
            flat = np.concatenate(found) if found else np.empty(0, np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64))], names=["h"])

        return step

    rows = docs.count()
    share = min(1.0, SAMPLE_ROWS / max(rows, 1))
    sample = docs.sample(share, 1) if share < 1 else docs
    counts = map_batches(sample.select("text"), make, "h long").groupBy("h").count().where(F.col("count") >= COMMON_FROM)
    top = counts.orderBy(F.desc("count"), "h").limit(MOST_COMMON).toArrow()
    hashes, seen = (top.column(i).to_numpy().astype(np.int64) for i in (0, 1))
    shards = np.ceil(seen / share / SHARD_ROWS).astype(int)
    return np.sort(hashes.view(np.uint64)), [(int(h), int(n)) for h, n in zip(hashes, shards, strict=True) if n > 1]


def bitmap(hashes: np.ndarray) -> bytes:
    """Which places the set's hashes fall on, of a power of two of them."""
    bits = max(LEAST_BITS, 1 << (2 * len(hashes) - 1).bit_length())
    place = np.zeros(bits, bool)
    place[hashes % np.uint64(bits)] = True
    return np.packbits(place, bitorder="little").tobytes()


def apart(x: bytes, y: bytes) -> int:
    """Members in which the sets of two bitmaps differ, at least; the longer bitmap is folded to the length of the other."""
    if len(x) < len(y):
        x, y = y, x
    wide, bits = int.from_bytes(x, "little"), 8 * len(x)
    while bits > 8 * len(y):
        bits //= 2
        wide = wide >> bits | wide & (1 << bits) - 1
    return (wide ^ int.from_bytes(y, "little")).bit_count()


def _rows(docs: DataFrame, common: np.ndarray, shingle: int) -> DataFrame:
    """doc_id, same (digest of the set), digest (of the text), size, fp (fingerprint), bits (bitmap), first (the shingles in which it meets
    others) for every row."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            same, size, fp, bits, first = [], [], [], [], []
            for x in batch.column(1).cast(pa.binary()):
                every = hashes_of(x.as_py(), shingle)
                hashes = np.unique(every)
                n = len(hashes)
                at = np.minimum(np.searchsorted(common, hashes), max(len(common) - 1, 0))
                late = common[at] == hashes if len(common) else np.zeros(n, bool)
                same.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                size.append(n)
                fp.append(majority(hashes))  # of the set, so that texts with equal sets have one fingerprint
                bits.append(bitmap(hashes))
                first.append(np.concatenate([hashes[~late], hashes[late]])[: n + PART * -n // WHOLE + 1].view(np.int64))
            fps = np.array(fp, np.uint64).view(np.int64)
            cols = [batch.column(0), pa.array(same, pa.binary()), batch.column(2), pa.array(size, pa.int64()), pa.array(fps), pa.array(bits, pa.binary()), pa.array(first, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "same", "digest", "size", "fp", "bits", "first"])

        return step

    return map_batches(docs.select("doc_id", "text", "digest"), make, "doc_id long, same binary, digest binary, size long, fp long, bits binary, first array<long>")


def _met(rows: DataFrame, low: int, high: int, first: bool) -> DataFrame:
    """rows (h, shard, node, at, root) -> pairs (other, node) to compare, with h null, and the rows of buckets that need another round.

    `at` holds the set's size and the shingle's place in it, 32 bits each. In the first round small buckets compare all pairs, and large ones
    and shards of larger ones all rows with their first; in the others, rows meet the roots from `low` up to `high`."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("h", "shard", "node", "at", "root")
    # a shard of -1 is a whole bucket
    dealt = dealt.repartition(parts, "h", "shard").sortWithinPartitions("h", "shard", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, n = None, [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None and batch.num_rows:
                waiting.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)])
                n += batch.num_rows
            if batch is not None and n < COMPARE_AT_ONCE:
                continue
            if not waiting:
                break
            cols = [np.concatenate(x) for x in zip(*([held] if held is not None else []), *waiting, strict=True)]
            waiting, n = [], 0
            whole = int(np.argmax((cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])))  # the last bucket may go on in the next batch
            held = [c[whole:] for c in cols]
            yield from buckets([c[:whole] for c in cols])
        if held is not None:
            yield from buckets(held)

    def buckets(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, shard, node, packed, root = cols
        if not len(h):
            return
        size, place = packed >> 32, packed & 0xFFFFFFFF
        new = np.r_[True, (h[1:] != h[:-1]) | (shard[1:] != shard[:-1])]
        group, begin = np.cumsum(new) - 1, np.flatnonzero(new)
        many = np.diff(np.r_[begin, len(h)])
        mixed = np.maximum.reduceat(root, begin) != np.minimum.reduceat(root, begin)
        open_rows = np.flatnonzero(mixed[group])
        rank, large = np.arange(len(h)) - begin[group], (many[group] > SMALL) | (shard >= 0)
        for k in range(low, high):
            at = open_rows[rank[open_rows] > k]
            if not len(at):
                break
            if first and k:
                at = at[~large[at]]
            other = begin[group[at]] + k
            x, y = size[at], size[other]
            left = np.minimum(x - place[at], y - place[other])  # most that they can share if this is the first shared one
            ok = (root[at] != root[other]) & ((PART + WHOLE) * left >= PART * (x + y))
            if ok.any():
                yield made(None, node[at][ok], node[other][ok])
        again = np.flatnonzero((shard >= 0) | mixed[group] & large) if first else open_rows[many[group[open_rows]] > high]
        if len(again):
            yield made(h[again], node[again], None, packed[again])

    def made(h, a, b, packed=None) -> pa.RecordBatch:
        cols = [pa.nulls(len(a), pa.int64()) if c is None else pa.array(c, pa.int64()) for c in (h, a, b, packed)]
        return pa.RecordBatch.from_arrays(cols, names=["h", "node", "other", "at"])

    return dealt.mapInArrow(returning(run), "h long, node long, other long, at long")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be sent to every task if its counted rows are few enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) whose bitmaps leave room for the similarity."""
    pairs = cut(pairs.where("a <> b").select("a", "b").distinct())
    a, b = (nodes.select(F.col("node").alias(f"n{c}"), F.col("size").alias(f"s{c}"), F.col("bits").alias(f"bits{c}")) for c in "ab")
    both = b.join(_small(pairs, pairs.count()), F.col("nb") == F.col("b")).join(a, F.col("na") == F.col("a"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            size = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            most = size * (WHOLE - PART) // (WHOLE + PART)
            keep = [apart(x.as_py(), y.as_py()) <= m for x, y, m in zip(batch.column(4), batch.column(5), most.tolist(), strict=True)]
            return batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

        return step

    return cut(map_batches(both.select("a", "b", "sa", "sb", "bitsa", "bitsb"), make, "a long, b long"))


def _texts(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, repeated: bool) -> DataFrame:
    """node, text of the nodes in pairs(a, b). A node's text is that of the one row with its digest and id; only if rows are
    `repeated` is there more than one of it."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = cut(nodes.select("node", F.col("digest").alias("d"), F.col("own").alias("o")).join(wanted, "node"))
    found = docs.join(_small(wanted, wanted.count()), F.expr("digest = d and doc_id <=> o")).select("node", "text")
    return cut(found.groupBy("node").agg(F.first("text").alias("text")) if repeated else found)


def _compared(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) of nodes that are similar enough. Each a is read once before the texts it is compared with, at most some SHARE in
    a task."""
    rows = pairs.count()
    many = cut(pairs.groupBy("a").count().where(F.col("count") > SHARE).select("a", F.ceil(F.col("count") / SHARE).alias("shares")))
    # fewer than rows / SHARE of them
    dealt = pairs.join(_small(many, many.count()), "a", "left").withColumn("share", F.pmod(F.xxhash64("b"), F.coalesce("shares", F.lit(1))))
    dealt = cut(dealt.select("a", "b", "share"))
    held = texts.select(F.col("node").alias("n"), "text")
    others = held.join(_small(dealt, rows), F.col("n") == F.col("b")).select("a", "share", "b", "text")
    own = held.join(_small(dealt.select("a", "share").distinct(), rows), F.col("n") == F.col("a")).select("a", "share", F.lit(None).cast("long").alias("b"), "text")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = own.unionByName(others).repartition(parts, "a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())

    def make():
        last = [None]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for b, text in zip(batch.column(2).to_pylist(), batch.column(3).cast(pa.binary()), strict=True):
                found = shingles(text.as_py(), shingle)
                if b is None:
                    last[0] = found
                keep.append(b is not None and similar(last[0], found))
            return batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

        return step

    return map_batches(both, make, "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per input row: doc_id, component_id (the smallest id of its component)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    docs = docs.withColumn("digest", F.unhex(F.md5("text")))
    small_batches(docs.sparkSession)
    common, hot = _common(docs, shingle)
    rows = cut(_rows(docs, common, shingle).withColumn("row", F.monotonically_increasing_id()))
    # where every row has an id of its own, that is its number, and the smallest number of a component is the result
    named_rows = rows.where("doc_id is null").isEmpty() and rows.groupBy("doc_id").count().where("count > 1").isEmpty()
    repeated = not named_rows and not rows.groupBy("doc_id", "digest").count().where("count > 1").isEmpty()
    rows = rows.withColumn("node", F.col("doc_id") if named_rows else F.col("row")).drop("row")
    # of the rows with one set, the first stands for all
    one = F.min(F.struct("node", "digest", F.col("doc_id").alias("own"))).alias("of")
    named = cut(rows.groupBy("same").agg(F.min("doc_id").alias("least"), one).select("same", "least", "of.*"))
    of_rows = rows.select("doc_id", F.col("node").alias("row"), "same").join(named.select("same", "node"), "same")
    of_rows = cut(of_rows.select("doc_id", "row", "node"))
    others = of_rows.where("row <> node").select(F.col("row").alias("node"))
    firsts = rows.drop("same", "digest", "doc_id").join(_small(others, others.count()), "node", "left_anti")
    nodes = cut(firsts.drop("first").join(named.select("node", "least", "digest", "own"), "node"))

    # by fingerprint: of each class one node stands for all, and classes within the radius are linked
    classes = cut(nodes.groupBy("fp").agg(F.min("node").alias("rep")))
    twins = nodes.join(classes, "fp").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    pairs = _possible(twins.unionByName(near_links(classes, RADIUS).select(F.col("b").alias("a"), F.col("a").alias("b"))), nodes)
    links = [cut(_compared(pairs, _texts(docs, nodes, pairs, repeated), shingle))]
    roots = components(links[0])

    # by shared shingles: all that is left
    own = _small(roots.select(F.col("node").alias("n"), "root"), roots.count())
    rooted = firsts.join(own, F.col("node") == F.col("n"), "left").select("node", "size", "first", F.coalesce("root", "node").alias("root"))
    bucket = rooted.select(F.posexplode("first").alias("place", "h"), "node", "root", "size")
    bucket = bucket.select("h", "node", "root", F.shiftleft("size", 32).bitwiseOR(F.col("place")).alias("at"))
    # at most MOST_COMMON rows
    shards = F.broadcast(docs.sparkSession.createDataFrame(hot, "h long, shards long"))
    bucket = bucket.join(shards, "h", "left").withColumn("shard", F.coalesce(F.pmod(F.xxhash64("node"), "shards"), F.lit(-1).cast("long")))
    low, high, first = 0, SMALL, True
    while True:
        met = cut(_met(bucket, low, high, first))
        pairs = _possible(met.where("h is null").select(F.col("other").alias("a"), F.col("node").alias("b")), nodes)
        new = cut(_compared(pairs, _texts(docs, nodes, pairs, repeated), shingle))
        if not new.isEmpty():
            links.append(new)
            roots = components(reduce(DataFrame.unionByName, links))
        left = met.where("h is not null").select("h", "node", "at")
        if left.isEmpty():
            break
        own = roots.select(F.col("node").alias("n"), "root")
        left = cut(left.join(own, F.col("node") == F.col("n"), "left").select("h", "node", "at", F.coalesce("root", "node").alias("root")))
        # buckets of one component are done
        several = left.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h")
        bucket = left.join(several, "h", "left_semi").withColumn("shard", F.lit(-1).cast("long"))
        low, high, first = (0, 64, False) if first else (high, high * 64, False)
    named = of_rows.select("doc_id", "node")
    if named_rows:
        of_node = roots.select(F.col("node").alias("n"), "root")
        return named.join(of_node, F.col("node") == F.col("n"), "left").select("doc_id", F.coalesce("root", "node").alias("component_id"))
    least = named.where("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("top")).where("b <> top")
    by_id = cut(named.join(least, "doc_id").select(F.col("node").alias("a"), "b").where("a <> b"))
    if not by_id.isEmpty():
        roots = components(reduce(DataFrame.unionByName, [*links, by_id]))
    rooted = cut(nodes.select("node", "least").join(roots.select("node", "root"), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(rooted.select("node", "root"), "node").join(smallest, "root").select("doc_id", "component_id")
