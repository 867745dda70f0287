import tempfile
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from netsets.llm.sstable import Reader, Writer, id_key, key_id
from netsets.llm.tokens import Encoder, lookup, read_shards, token_output, write_shards

PATH = public_tokenizers.path("word_bpe_49k.json")
SPEC = open(PATH, encoding="utf-8").read()
WHOLE = Tokenizer.from_file(PATH)


def ids(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from(["'s", "a", " ", "\n", "é", "é", "́", "\x1c", "\x85", "　", "12", "<|endoftext|>", "Σ", "ΑΣ", "İ", "..", "a'll"])).map("".join))
def test_pieces_encode_as_the_whole_text(text):
    assert list(np.frombuffer(Encoder.of(SPEC)(text.encode()), "<u2")) == ids(text)[:-1]


def test_round_trip(spark):
    rows = [(5, "Hello world"), (-3, None), (None, "no id"), (5, "again 5"), (2**62, "x" * 5000), (9, ""), (7, "a b c " * 30_000)] + [(i, f"doc {i} " * (i % 9)) for i in range(100, 400)]
    docs = spark.createDataFrame([(*r, 0, "y") for r in rows], "doc_id long, text string, h int, start string").repartition(3)
    got = token_output(spark, docs, PATH).collect()
    want = sorted(rows, key=lambda r: id_key(r[0]))
    assert sorted(r.start for r in got)[0] == 0 and len(got) == len(rows)
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in by_start] == [r[0] for r in want]
    at = 0
    for r in by_start:
        assert r.start == at
        at += r.n_tokens
    crc = lambda x: (len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), *crc(ids(t))) for i, t in rows)
    manifest = write_shards(docs, SPEC, "file://" + tempfile.mkdtemp())
    assert [list(x) for x in lookup(manifest, -3, 2)] == [[1]] and lookup(manifest, 12, 2) == []
    assert sorted(map(list, lookup(manifest, 5, 2))) == sorted([ids("Hello world"), ids("again 5")])
    assert read_shards(manifest, 2).count() == len(rows)
    assert token_output(spark, docs.limit(0), PATH).collect() == []


def test_table_search():
    path = f"file://{tempfile.mkdtemp()}/t.nsst"
    w = Writer(path, "x")
    for i in range(0, 30_000, 3):
        w.add(id_key(i), str(i).encode() * 5)
    for _ in range(40):
        w.add(id_key(90_000), b"z" * 5000)
    w.close()
    r = Reader(path)
    assert all(r.get(id_key(i)) == [str(i).encode() * 5] for i in range(0, 30_000, 333))
    assert r.get(id_key(1)) == [] and len(r.get(id_key(90_000))) == 40 and r.get(id_key(10**9)) == []
    assert sum(r.may_hold(id_key(i)) for i in range(1, 30_000, 3)) < 400
    assert [key_id(k) for k, _ in r.scan()][:3] == [0, 3, 6] and key_id(id_key(None)) is None
