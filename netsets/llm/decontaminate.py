"""Benchmark decontamination by Wu-Manber search over words.

A pattern is a window of `window` consecutive item words (a shorter item is one pattern). Patterns of one length form a
table: a block is two words, and the shift of its checksum says how far the search may move when a window ends in such a block
(the least of all blocks with that checksum). Zero leads to the bucket of patterns with this last block and the same first word,
which are compared word by word. Tables are packed arrays over the items' text: some 40 bytes a pattern. They are compiled once in a
worker process, which holds those of one block of items at a time. Text is read once per block of ITEM_BLOCK_BYTES of items, each
broadcast at no more than that, and what is found is written to the shared folder between blocks: the benchmark may be of any size.

Defined cases: null or empty text has no words and is clean; an item without words is never found; an item without an id
marks words but is not counted or listed; ids that repeat count once; an empty table on either side gives the defined rows with
nothing found; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsets.llm.common import cut, map_batches, small_batches, text_of

WINDOW = 10
ITEM_BLOCK_BYTES = 16 << 20

#: Bytes of words: digits, small letters (capitals become small) and all of UTF-8 beyond ASCII; the rest become spaces.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()



def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """All parts as one array; the list is emptied."""
    out = np.concatenate(parts)
    parts.clear()
    return out


class WuManber:
    """Patterns of one length in words; find() gives (start, item number) of every occurrence, overlapping ones too."""

    def __init__(self, length: int, texts: list[bytes], numbers: list[int]):
        """texts: items as words joined by single spaces, `length` of them at least; numbers: what each item is called."""
        self.length = length
        self.block = min(2, length)
        self.furthest = length - self.block + 1
        flat, begins, ends, first, last, whole, owner = [], [], [], [], [], [], []
        place = 0
        kind = np.uint32 if sum(map(len, texts)) < 1 << 32 else np.uint64
        blocks: list[np.ndarray] = []
        for text, number in zip(texts, numbers, strict=True):
            words = text.split()
            n = len(words) - length + 1
            sums = [crc32(w) for w in words]
            pairs = sums if self.block == 1 else [0, *(crc32(w, c) for w, c in zip(words[1:], sums, strict=False))]
            pairs = np.array(pairs, np.uint32)
            size = np.fromiter(map(len, words), np.int64, len(words))
            end = np.cumsum(size + 1) - 1
            begin = end - size
            spans = zip(begin[:n].tolist(), end[length - 1 :].tolist(), strict=True)
            whole.append(np.fromiter((xxhash.xxh64_intdigest(text[a:b]) for a, b in spans), np.uint64, n))
            begins.append((begin[:n] + place).astype(kind))
            ends.append((end[length - 1 :] + place).astype(kind))
            first.append(np.array(sums[:n], np.uint32))
            last.append(pairs[length - 1 :])
            owner.append(np.full(n, number, np.int32))
            blocks.append(pairs)
            flat.append(text)
            place += len(text)
        self.flat = b"".join(flat)
        flat.clear()
        # the least shift of each checksum, where blocks end `back` words before a window's last one
        self.mask = (1 << max(8, (2 * sum(map(len, blocks))).bit_length())) - 1
        wide = self.furthest > 255
        self.shift = [self.furthest] * (self.mask + 1) if wide else bytearray([self.furthest]) * (self.mask + 1)
        shift = np.array(self.shift, np.int64) if wide else np.frombuffer(self.shift, np.uint8)
        for pairs in blocks:
            n = len(pairs)
            at = (pairs & np.uint32(self.mask)).astype(np.int64)
            for back in range(self.furthest - 1, -1, -1):
                # a block at i ends `back` words before some window's end if that window lies in the item
                part = at[max(self.block - 1, length - 1 - back) : n - back]
                shift[part] = np.minimum(shift[part], back)
        self.shift = shift.tolist() if wide else self.shift
        blocks.clear()
        # of equal windows of an item one is enough
        key = _joined(last).astype(np.uint64)
        key <<= np.uint64(32)
        key |= _joined(first)
        owner, whole = _joined(owner), _joined(whole)
        order = np.lexsort((owner, whole, key)).astype(np.uint32)
        kept = np.zeros(len(order), bool)
        for column in (key, whole, owner):
            column = column[order]
            kept[1:] |= column[1:] != column[:-1]
        kept[:1] = True
        order = order[kept]
        del whole, kept, column
        self.key, self.owner = key[order], owner[order]
        del key, owner
        self.begin = _joined(begins)[order]
        self.end = _joined(ends)[order]
        # which (last block, first word) exist, by a short checksum, so that most places are left without a search
        self.probe_mask = (1 << max(8, (4 * len(self.key)).bit_length())) - 1
        self.probe = bytearray(self.probe_mask + 1)
        np.frombuffer(self.probe, np.uint8)[((self.key >> np.uint64(32)) ^ self.key) & np.uint64(self.probe_mask)] = 1

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        length, shift, mask, probe, probe_mask = self.length, self.shift, self.mask, self.probe, self.probe_mask
        two = self.block == 2
        at, n = length - 1, len(words)
        while at < n:
            last = crc32(words[at], crc32(words[at - 1])) if two else crc32(words[at])
            step = shift[last & mask]
            if step:
                at += step
                continue
            start = at - length + 1
            first = crc32(words[start])
            if probe[(last ^ first) & probe_mask]:
                key = np.uint64(last << 32 | first)
                low = int(np.searchsorted(self.key, key, "left"))
                if low < len(self.key) and self.key[low] == key:
                    window = b" ".join(words[start : at + 1])
                    for i in range(low, int(np.searchsorted(self.key, key, "right"))):
                        if self.flat[self.begin[i] : self.end[i]] == window:
                            yield start, int(self.owner[i])
            at += 1


class Compiled:
    """The tables of one block of items, a table for each length of pattern, and the items' ids."""

    #: key of the block that this process holds -> its tables
    held: dict[str, Compiled] = {}

    def __init__(self, items: Iterable[tuple[int | None, bytes]], window: int):
        ids, texts, numbers = [], {}, {}
        for number, (item_id, text) in enumerate(items):
            ids.append(item_id)
            words = words_of(text)
            if words:
                n = min(window, len(words))
                texts.setdefault(n, []).append(b" ".join(words))
                numbers.setdefault(n, []).append(number)
        self.ids = pa.array(ids, pa.int64())
        self.tables = [WuManber(n, texts.pop(n), numbers.pop(n)) for n in sorted(texts)]

    def id_of(self, number: int) -> int | None:
        return self.ids[number].as_py()

    @classmethod
    def of(cls, key: str, shared, window: int) -> Compiled:
        """Compiled once in a process; tables of another block are let go first."""
        if key not in cls.held:
            cls.held.clear()
            cls.held[key] = cls(shared.value, window)
        return cls.held[key]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, bytes]]]:
    """Items in blocks of bounded size, one at a time on the driver. Always at least one, perhaps empty."""
    block, size = [], 0
    for item_id, text in benchmark.select(F.col(id_col).cast("long"), text_of(text_col)).toLocalIterator():
        raw = text.encode()
        if block and size + len(raw) > ITEM_BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((item_id, raw))
        size += len(raw)
    yield block


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
ITEMS = pa.list_(pa.int64())


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items, items_sha256, contaminated, hit_spans (in words, end exclusive)."""
    spark = docs.sparkSession
    state = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    state = state.select("*", F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.lit(None).cast("array<bigint>").alias("items"))
    blocks = _blocks(benchmark, item_id_col, item_text_col)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        state = _search(state, spark.sparkContext.broadcast(block), window, last=following is None)
        if following is not None:
            state = cut(state)  # a worker then holds the tables of one block, not of all
        block = following
    return state


def _search(state: DataFrame, shared, window: int, last: bool) -> DataFrame:
    name = uuid.uuid4().hex

    def make():
        compiled = Compiled.of(name, shared, window)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text, spans, items in zip(batch.column(1).cast(pa.binary()), batch.column(2), batch.column(3), strict=True):
                words = words_of(text.as_py())
                found = [(x["start"], x["end"]) for x in spans.as_py() or ()]
                known = set(items.as_py() or ())
                numbers = set()
                for table in compiled.tables:
                    for start, number in table.find(words):
                        found.append((start, start + table.length))
                        numbers.add(number)
                known.update(i for i in map(compiled.id_of, numbers) if i is not None)
                rows.append((len(words), _merged(found), sorted(known, key=str)))
            spans = pa.array([[{"start": a, "end": b} for a, b in r[1]] for r in rows], SPANS)
            items = pa.array([r[2] for r in rows], ITEMS)
            if not last:
                return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), spans, items], names=["doc_id", "text", "spans", "items"])
            hit = [sum(b - a for a, b in r[1]) for r in rows]
            named = [hashlib.sha256(",".join(map(str, r[2])).encode()).hexdigest() for r in rows]
            cols = [
                batch.column(0),
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array(hit, pa.int64()),
                pa.array([len(r[2]) for r in rows], pa.int64()),
                items,
                pa.array(named, pa.string()),
                pa.array([n > 0 for n in hit], pa.bool_()),
                spans,
            ]
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated", "hit_spans"])

        return step

    kind = "array<struct<start:bigint,end:bigint>>"
    schema = (
        f"doc_id long, n_words long, n_hit long, n_items long, items array<bigint>, items_sha256 string, contaminated boolean, hit_spans {kind}"
        if last
        else f"doc_id long, text string, spans {kind}, items array<bigint>"
    )
    return map_batches(state, make, schema)


def with_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, flag_col: str = "contaminated") -> DataFrame:
    """docs with a flag whether any window occurs; all other columns untouched, and nothing is shuffled."""
    small_batches(docs.sparkSession)
    blocks = _blocks(benchmark, item_id_col, item_text_col)
    block = next(blocks)
    docs = docs.withColumn(flag_col, F.lit(False))
    while block is not None:
        following = next(blocks, None)
        docs = docs.withColumn(flag_col, F.col(flag_col) | _occurs(docs.sparkSession.sparkContext.broadcast(block), window)(text_of(text_col)))
        if following is not None:
            docs = cut(docs)
        block = following
    return docs


def _occurs(shared, window: int):
    name = uuid.uuid4().hex

    @F.pandas_udf("boolean")
    def occurs(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tables = Compiled.of(name, shared, window).tables
        for texts in batches:
            out = []
            for text in texts:
                words = words_of(text.encode())
                out.append(any(next(table.find(words), None) is not None for table in tables))
            yield pd.Series(out, dtype=bool)

    return occurs
