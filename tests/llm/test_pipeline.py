import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as cp
from netsets.llm.toxicity import toxicity
from tests.llm.test_decontaminate import words
from tests.llm.test_jaccard import slow_roots
from tests.llm.test_tokens import ids

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.cache()]
    for _, stage in cp.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
        out[-1].count()
    return out


def test_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])
    assert stages[-1].columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_toxicity(spark, stages):
    said = {r.doc_id: r.predicted for r in toxicity(stages[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert {r.doc_id for r in stages[1].collect()} == {i for i, p in said.items() if not p}


def test_near_copies(stages):
    rows = sorted((r.doc_id, r.text) for r in stages[1].collect())
    assert sorted(r.doc_id for r in stages[2].collect()) == [i for i, root in slow_roots(rows) if i == root]


def test_benchmark(spark, stages):
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n}
    clean = []
    for r in stages[2].collect():
        w = words(r.text)
        if not any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1)):
            clean.append(r.doc_id)
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(clean)


def test_mixing(stages):
    size = {r.doc_id: len(r.text.split()) for r in stages[3].collect()}
    times = Counter(r.doc_id for r in stages[4].collect())
    assert set(times) <= set(size) and max(times.values()) <= 2
    total = sum(size.values())
    assert abs(sum(size[i] * n for i, n in times.items()) - 1.5 * total) < 0.1 * total


def test_tokens(stages):
    want = Counter((r.doc_id, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r in stages[4].collect() for x in [ids(r.text)])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in stages[5].collect()) == want


def test_odd_rows(spark):
    rows = [(1, "a b c d", "s"), (1, "a b c d", "s"), (None, "q w e", None), (None, "q w e", None), (2, None, "s"), (3, "", "t"), (4, "a b c d", "t"), (1, "other text for one", "s")]
    docs = spark.createDataFrame([(*r, 5, 6) for r in rows], "doc_id long, text string, source string, copies int, rows int")
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "source", "copies", "rows"]
        assert stage(spark, docs.limit(0), SF).count() == 0
    kept = Counter(r.doc_id for r in docs.collect())
    assert set(kept) <= {1, 2, 3, None}


def test_run(spark, stages):
    assert {tuple(r) for r in cp.run(spark, SF).collect()} == {tuple(r) for r in stages[-1].collect()}
