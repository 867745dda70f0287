"""SimHash near-deduplication: fingerprints, links within a Hamming radius by bit-sliced comparison, components.

Fingerprints equal bit for bit are one class. With 64 bits in BLOCKS parts, two fingerprints within the radius agree on
all but `radius` parts, so classes meet under every choice of BLOCKS - radius parts. A bucket (choice, their bits) of at most
BUCKET classes is compared bit-sliced in one task. A larger one is dealt again: its members also agree on all but `radius`
of the parts that its free bits are cut into, so finer keys lose no pair; after the last refinement a bucket can't hold more
than 2**FREE_BITS_LEFT classes. Buckets give a link from each linked class to one root, never their pairs, and the components
come from contracting these links round by round, each round written to the shared folder, until FINISH_LINKS are left for one task.

Defined cases: null text counts as empty; a text without words has fingerprint zero and links like any other; documents with
the same id are one node; a null id takes part as a document of its own (two of them meet only where their fingerprints do), and its
component_id is the smallest id of its component that is not null, or null; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsets.llm.bitslice import group_links
from netsets.llm.common import cut, map_batches, returning, text_of

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Parts that the bits are cut into at each refinement: 64 bits -> 6 keys of 32; what is free -> 3 parts, one of which agrees.
BLOCKS = 4
BUCKET = 2048
FREE_BITS_LEFT = 14
#: Shingles whose bits are counted at once.
COUNT_AT_ONCE = 1 << 14
#: Bucket rows that one call compares, besides a bucket that goes on.
COMPARE_AT_ONCE = 1 << 14

#: ASCII capitals to small letters; every other byte, UTF-8 or not, stays.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.translate(LOWER).split()
    if not words:
        return 0
    flat = b" ".join(words)
    n = len(words) - shingle + 1
    if n < 2:
        return xxhash.xxh64_intdigest(flat, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    begins = ends - lengths
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(flat[a:b], SEED) for a, b in zip(begins[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n
    )
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the 64-bit hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNT_AT_ONCE):
        part = hashes[at : at + COUNT_AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (64 bits as a signed long) for every row."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = (fingerprint(x.as_py(), shingle) for x in batch.column(1).cast(pa.binary()))
            fps = np.fromiter(made, np.uint64, batch.num_rows).view(np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

        return step

    return map_batches(docs.select(F.col(id_col).cast("long"), text_of(text_col)), make, "doc_id long, fp long")


def _spans(low: int, high: int, parts: int) -> list[tuple[int, int]]:
    edges = [low + (high - low) * i // parts for i in range(parts + 1)]
    return list(zip(edges, edges[1:], strict=False))


def _masks(radius: int) -> list[list[tuple[int, list[int]]]]:
    """Refinements: for each, (mask of a coarser key, finer masks that between them keep every pair of that key)."""
    whole = (1 << 64) - 1
    spans = _spans(0, 64, radius + 2)
    bits = lambda chosen: sum((1 << b) - (1 << a) for a, b in chosen)
    level = [bits(c) for c in combinations(spans, 2)]
    out = [[(0, level)]]
    while True:
        free = [64 - m.bit_count() for m in level]
        if max(free) <= FREE_BITS_LEFT:
            return out
        refined = []
        for mask in level:
            open_bits = [i for i in range(64) if not mask >> i & 1]
            parts = _spans(0, len(open_bits), radius + 1)
            refined.append((mask, [mask | sum(1 << open_bits[i] for i in range(a, b)) for a, b in parts]))
        out.append(refined)
        level = [m for _, finer in refined for m in finer]
        assert all(m <= whole for m in level)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _links_in_buckets(rows: DataFrame, radius: int) -> DataFrame:
    """rows (mask, bits, fp, rep) -> (a, b): each class with a link in its bucket, and the bucket's root for it."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "mask", "bits").sortWithinPartitions("mask", "bits", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, rows = None, [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None and batch.num_rows:
                waiting.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
                rows += batch.num_rows
            if batch is not None and rows < COMPARE_AT_ONCE:
                continue
            if not waiting:
                break
            cols = [np.concatenate(x) for x in zip(*([held] if held is not None else []), *waiting, strict=True)]
            waiting, rows = [], 0
            # the last bucket may go on in the next batch
            last = len(cols[0]) - 1
            same = (cols[0] == cols[0][last]) & (cols[1] == cols[1][last])
            whole = int(np.argmax(same))
            held = [c[whole:] for c in cols]
            yield from links([c[:whole] for c in cols])
        if held is not None:
            yield from links(held)

    def links(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        mask, bits, fp, rep = cols
        if len(fp) < 2:
            return
        group = np.cumsum(np.r_[0, (mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])])
        member, root = group_links(fp.view(np.uint64), group, radius)
        if len(member):
            yield pa.RecordBatch.from_arrays([pa.array(rep[member]), pa.array(rep[root])], names=["a", "b"])

    return dealt.mapInArrow(returning(run), "a long, b long")


def near_links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """classes (fp, rep), distinct fps -> links (a, b) whose components are those of all pairs within the radius."""
    found, pending = [], classes.withColumn("mask", F.lit(0).cast("long"))
    levels = _masks(radius)
    for depth, level in enumerate(levels):
        keyed = [F.when(F.col("mask") == _signed(mask), F.array(*[F.lit(_signed(m)) for m in finer])) for mask, finer in level]
        dealt = pending.select("fp", "rep", F.explode(F.coalesce(*keyed)).alias("mask"))
        dealt = dealt.withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))
        if depth + 1 == len(levels):
            found.append(_links_in_buckets(dealt.select("mask", "bits", "fp", "rep"), radius))
            break
        large = cut(dealt.groupBy("mask", "bits").count().where(F.col("count") > BUCKET).select("mask", "bits"))
        if large.isEmpty():
            found.append(_links_in_buckets(dealt.select("mask", "bits", "fp", "rep"), radius))
            break
        found.append(_links_in_buckets(dealt.join(large, ["mask", "bits"], "left_anti").select("mask", "bits", "fp", "rep"), radius))
        pending = dealt.join(large, ["mask", "bits"], "left_semi").select("fp", "rep", "mask")
    return reduce(DataFrame.unionByName, found)


#: Links that one task may finish (some 40 MB); more are contracted by joins first. The components are the same either way.
FINISH_LINKS = 200_000


def _finished(links: DataFrame) -> DataFrame:
    """(node, root) from a bounded number of links (a, b), by union-find in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while (above := up.setdefault(x, x)) != x:
                up[x] = x = up.setdefault(above, above)
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(a), find(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        if up:
            yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([find(x) for x in up], pa.int64())], names=["node", "root"])

    return links.select("a", "b").coalesce(1).mapInArrow(returning(run), "node long, root long")


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, root) for every node with a link: root is the smallest node of its component.

    Each round hooks every node to its smallest neighbour, shortens the hooks to stars, and keeps the links between stars; once few links
    are left, one task ends it.
    """
    step = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = None
    while count := step.count():
        if count <= FINISH_LINKS:
            hooks = cut(_finished(step))
        else:
            both = step.select("a", "b").union(step.select("b", "a"))
            hooks = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
            while True:
                up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
                jumped = cut(hooks.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")))
                hooks = jumped.select("node", "root")
                if jumped.where("moved").isEmpty():
                    break
        if roots is None:
            roots = hooks
        else:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            roots = cut(roots.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")))
        if count <= FINISH_LINKS:
            break
        a, b = (hooks.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        step = step.join(a, "a").join(b, "b").where("ra <> rb")
        step = cut(step.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    return roots if roots is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id."""
    signed = cut(fingerprints(docs, id_col, text_col, shingle))
    named = signed.where("doc_id is not null")
    # rows without an id leave a class without a name, and an id with different texts joins classes: then fingerprints are the nodes
    nameless = not signed.where("doc_id is null").isEmpty()
    several = named.groupBy("doc_id").agg(F.min("fp").alias("b"), F.max("fp").alias("g")).where("b <> g").select("doc_id", "b")
    several = cut(several)
    classes = cut(signed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    if nameless or not several.isEmpty():
        nodes = classes.select("fp", F.col("fp").alias("rep"))
        by_id = named.join(several, "doc_id").select(F.col("fp").alias("a"), "b").where("a <> b")
        roots = components(near_links(nodes, radius).unionByName(by_id))
        of_class = cut(classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
        smallest = of_class.groupBy("root").agg(F.min("least").alias("component_id"))
        labels = of_class.join(smallest, "root").select("fp", "component_id")
    else:
        nodes = classes.select("fp", F.col("least").alias("rep"))
        roots = components(near_links(nodes, radius))
        labels = nodes.join(roots, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return signed.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
