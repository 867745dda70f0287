"""Token-ID output: documents encoded, and written as sorted-string-table shards in id order.

Rows are dealt by ranges of (id, text hash), so that shards follow each other and repeated ids split like any others; each
task sorts, encodes and writes its range, a new shard after SHARD_BYTES. A shard appears under its name only when whole,
and the manifest lists what finished tasks report, so lost executors leave at most unlisted files.

Encoding splits at ASCII white space, at which the tokenizer always splits too and which it drops, remembers the ids of
short pieces, and gives new ones to the tokenizer many at a time. Case is dropped first, as the tokenizer does. That gives
the same ids as encoding the whole text; use it only with lower-casing tokenizers that drop white space.

Defined cases: null or empty text gives the end id alone; a null id sorts first; rows with equal ids keep an entry each, in
order of their text's hash, then text; an empty table gives no shard; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsets.llm.common import fresh_path, small_batches, text_of
from netsets.llm.sstable import Reader, Writer, id_key, key_id

SHARD_BYTES = 64 << 20
#: Pieces remembered by a worker, and the longest that are: bounds of its memory.
CACHE_PIECES, CACHE_PIECE_BYTES = 1_200_000, 48
#: Text bytes whose new pieces are encoded together.
AT_ONCE = 1 << 20

WORD_END = "</w>"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: Small ASCII or Latin-1 letters, perhaps with one mark after them: the letters are one word of the tokenizer, the mark another.
LETTERS_MARK = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([.,;:!?]?)")

MANIFEST = "shard string, part int, seq int, entries long, tokens long, first_id long, last_id long"


def _places_of_none(values: list) -> list[int]:
    out, at = [], -1
    try:
        while True:
            at = values.index(None, at + 1)
            out.append(at)
    except ValueError:
        return out


class Encoder:
    """Texts as bytes -> their ids as little-endian integers of `width` bytes."""

    held: dict[int, Encoder] = {}

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith(WORD_END)]] = True
        # for words that are small letters already, the same model without the steps that would not change them
        plain = json.loads(spec)
        plain |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, BYTE_LEVEL]}}
        by_bytes = BYTE_LEVEL["type"] in json.dumps(json.loads(spec).get("pre_tokenizer"))
        self.for_words = Tokenizer.from_str(json.dumps(plain)) if by_bytes else self.tokenizer
        self.known: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, spec: str) -> Encoder:
        """One per worker process, so that what it remembers outlives a task."""
        key = zlib.crc32(spec.encode())
        if key not in cls.held:
            cls.held[key] = cls(spec)
        return cls.held[key]

    def __call__(self, text: bytes) -> bytes:
        return next(self.all([text]))

    def all(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        """One result per text, in order. Texts wait until AT_ONCE bytes have come, so that new pieces are encoded together."""
        waiting, size = [], 0
        for text in texts:
            # the tokenizer makes letters small itself; doing so first lets more pieces be known. Special tokens stay as written.
            waiting.append((text if b"<|" in text else text.translate(LOWER)).split())
            size += len(text)
            if size >= AT_ONCE:
                yield from self._encoded(waiting)
                waiting, size = [], 0
        yield from self._encoded(waiting)

    def _encoded(self, texts: list[list[bytes]]) -> Iterator[bytes]:
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        known = self.known
        found = [list(map(known.get, pieces)) for pieces in texts]
        gaps = [_places_of_none(ids) for ids in found]
        fresh = self._pieces({pieces[i] for pieces, at in zip(texts, gaps, strict=True) for i in at})
        for pieces, ids, at in zip(texts, found, gaps, strict=True):
            for i in at:
                ids[i] = fresh[pieces[i]]
            yield b"".join(ids)
        known.update((p, ids) for p, ids in fresh.items() if len(p) <= CACHE_PIECE_BYTES)

    def _pieces(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        words, marked, others = set(), [], []
        for piece in pieces:
            found = LETTERS_MARK.fullmatch(piece)
            if not found:
                others.append(piece)
            elif found[2]:
                marked.append((piece, found[1], found[2]))
                words.add(found[1])
            else:
                words.add(piece)
        others += {mark for _, _, mark in marked} - pieces
        out = self._words([w for w in words if w not in self.known])
        encoded = self.tokenizer.encode_batch_fast([p.decode("utf-8") for p in others], add_special_tokens=False)
        out.update((p, np.array(e.ids, self.kind).tobytes()) for p, e in zip(others, encoded, strict=True))
        for piece, word, mark in marked:
            out[piece] = (out.get(word) or self.known[word]) + out[mark]
        return out

    def _words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Runs of letters, which never meet across a space: many are encoded as one text and cut after each word's last token."""
        out = {}
        for at in range(0, len(words), 512):
            part = words[at : at + 512]
            joined = b" ".join(part).decode("utf-8")
            ids = np.array(self.for_words.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int64)
            ends = (np.flatnonzero(self.ends[ids]) + 1) * self.width if len(ids) else np.zeros(0, np.int64)
            if len(ends) == len(part):
                raw, edges = ids.astype(self.kind).tobytes(), [0, *ends.tolist()]
                out.update((w, raw[a:b]) for w, a, b in zip(part, edges, edges[1:], strict=False))
            else:  # a tokenizer without word ends
                encoded = self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in part], add_special_tokens=False)
                out.update((w, np.array(e.ids, self.kind).tobytes()) for w, e in zip(part, encoded, strict=True))
        return out


def write_shards(docs: DataFrame, spec: str, out: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """Writes shards under `out` (a folder that all executors share) and returns their manifest, in order. Runs at once."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    thin = thin.withColumn("h", F.xxhash64("text"))
    dealt = thin.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "text")
    shared = spark.sparkContext.broadcast(spec)
    small_batches(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.of(shared.value)
        end = np.array([end_id], encode.kind).tobytes()
        task = TaskContext.get()
        part, attempt = task.partitionId(), f"{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        writer, rows, first, last = None, [], None, None

        def close() -> None:
            writer.close()
            rows.append((writer_name, part, len(rows), writer.entries, writer.value_bytes // encode.width, first, last))

        for batch in batches:
            encoded = encode.all(text.as_py() for text in batch.column("text").cast(pa.binary()))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                ids += end
                if writer is None:
                    writer_name, first = f"{out}/shard-{part:06d}-{len(rows):04d}-{attempt}.nsst", doc_id
                    writer = Writer(writer_name, attempt)
                writer.add(id_key(doc_id), ids)
                last = doc_id
                if writer.value_bytes >= SHARD_BYTES:
                    close()
                    writer = None
        if writer is not None:
            close()
        if rows:
            names = ("shard", "part", "seq", "entries", "tokens", "first_id", "last_id")
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))

    from pyarrow import fs as pafs

    made, path = pafs.FileSystem.from_uri(out)
    made.create_dir(path, recursive=True)
    # one row per shard of at least one range or SHARD_BYTES: what the driver holds is the list of files
    manifest = dealt.mapInArrow(write, MANIFEST).collect()
    return spark.createDataFrame(sorted(manifest, key=lambda r: (r.part, r.seq)), MANIFEST)


def read_shards(manifest: DataFrame, width: int) -> DataFrame:
    """One row per entry, from the files: doc_id, start (ids before it), n_tokens, ids_crc32 (of ids as u32), ids not kept."""
    spark = manifest.sparkSession
    shards, before = [], 0
    for r in sorted(manifest.collect(), key=lambda r: (r.part, r.seq)):
        shards.append((r.shard, before))
        before += r.tokens
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for shard, start in zip(batch.column("shard").to_pylist(), batch.column("start").to_pylist(), strict=True):
                reader, rows = Reader(shard), []
                for key, value in reader.scan():
                    n = len(value) // width
                    crc = zlib.crc32(value if width == 4 else np.frombuffer(value, f"<u{width}").astype("<u4").tobytes())
                    rows.append((key_id(key), start, n, crc))
                    start += n
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
                        rows = []
                reader.close()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    frame = spark.createDataFrame(shards, "shard string, start long")
    return frame.repartitionByRange(len(shards), "start").mapInArrow(read, schema)


def lookup(manifest: DataFrame, doc_id: int | None, width: int) -> list[np.ndarray]:
    """Ids of one document: its shards by their id ranges, then binary search in the files."""
    key, found = id_key(doc_id), []
    for r in manifest.collect():
        if id_key(r.first_id) <= key <= id_key(r.last_id):
            reader = Reader(r.shard)
            found += [np.frombuffer(v, f"<u{width}") for v in reader.get(key)]
            reader.close()
    return found


def token_output(spark: SparkSession, docs: DataFrame, tokenizer_path: str, out: str | None = None, **columns) -> DataFrame:
    """Encodes, writes and reads back: doc_id, start, n_tokens, ids_crc32 for every row of docs."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    out = out or fresh_path(spark, "tokens")
    if "://" not in out:
        out = f"file:{out}" if out.startswith("/") else out
    out = out.replace("file:///", "file:/").replace("file:/", "file:///")
    return read_shards(write_shards(docs, spec, out, **columns), Encoder.of(spec).width)
