"""The registered queries against their SQL, or against brute force where they have none, on the smallest tables."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest

from netsets.llm.queries import ORACLES, QUERIES
from tests.llm.test_pii import slow as slow_pii
from tests.llm.test_secrets import slow as slow_secrets
from tests.llm.test_simhash import slow_components, slow_fingerprint
from tests.llm.test_tokens import ids

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.fixture(scope="module")
def docs(duck):
    return duck.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(repr, want))


def test_op4(spark, docs):
    fps = [slow_fingerprint(t) for _, t in docs]
    want = {(i, f"{f:016x}", docs[c][0]) for (i, _), f, c in zip(docs, fps, slow_components(fps), strict=True)}
    assert {tuple(r) for r in QUERIES["op4_simhash_near_dedup"](spark, SF).collect()} == want


def named(spans):
    return hashlib.sha256(spans.encode()).hexdigest()


def test_op6(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op6_secret_scan"](spark, SF).collect()}
    for i, t in docs:
        spans = slow_secrets(t)
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        assert got[i].base_sha256 == named(text) and set(filter(None, text.split(","))) <= set(got[i].spans.split(","))


def test_op8(spark, docs):
    at, want = 0, set()
    for i, t in docs:
        x = ids(t)
        want.add((i, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    assert {tuple(r) for r in QUERIES["op8_token_shards"](spark, SF).collect()} == want


def test_op10(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op10_personal_data"](spark, SF).collect()}
    for i, t in docs:
        text = ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for k, a, b in slow_pii(t))
        assert got[i].base_sha256 == named(text) and set(filter(None, text.split(","))) <= set(got[i].spans.split(","))


def test_op1(spark, duck):
    got = {r.doc_id: r for r in QUERIES["op1_toxicity"](spark, SF).collect()}
    known = duck.sql("SELECT doc_id, max(toxic) FROM labels GROUP BY 1").fetchall()
    held = [(got[i].predicted, y) for i, y in known if i in got and got[i].held_out]
    assert sum(p == y for p, y in held) >= 0.85 * len(held)
