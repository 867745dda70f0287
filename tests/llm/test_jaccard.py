import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as cp
from netsets.llm import jaccard
from netsets.llm.jaccard import near_copies


def slow_sets(texts, n=5):
    out = []
    for t in texts:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        out.append({b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))})
    return out


def slow_roots(rows):
    """rows (id, text) -> smallest id of each row's component."""
    sets, root = slow_sets([t for _, t in rows]), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0]
            if same_id or shared >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [(i, least.get(r)) for (i, _), r in zip(rows, root, strict=True)]


def made(rng):
    vocabulary = [f"w{i}" for i in range(400)]
    line = " ".join(rng.choices(vocabulary, k=30))
    texts = [None, "", " \t", "one two", "One  TWO", "a b c d", "a b c d e"]
    for size in (12, 30, 60, 200):
        for _ in range(6):
            base = rng.choices(vocabulary, k=size)
            for changes in (0, 0, 1, 1, 2, 3, 6):
                copy = list(base)
                for _ in range(changes):
                    copy[rng.randrange(size)] = rng.choice(vocabulary)
                texts.append(" ".join(copy))
        texts += [line + " " + " ".join(rng.choices(vocabulary, k=size // 4)) for _ in range(12)]
    rng.shuffle(texts)
    return [(1000 - i, t) for i, t in enumerate(texts)] + [(7, "repeated id one"), (7, "repeated id two"), (None, "no id"), (None, texts[0])]


@pytest.mark.parametrize("small, shard", [(8, 1000), (1, 1000), (8, 2)])
def test_against_brute_force(spark, monkeypatch, small, shard):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "SHARD_ROWS", shard)
    monkeypatch.setattr(jaccard, "SAMPLE_ROWS", 100)
    rows = made(random.Random(small + shard))
    docs = spark.createDataFrame([(*r, 5, 6) for r in rows], "doc_id long, text string, node long, h long").repartition(3)
    assert Counter(map(tuple, near_copies(docs).collect())) == Counter(slow_roots(rows))
    assert near_copies(docs.limit(0)).collect() == []


@pytest.mark.parametrize("shard", [1000, 20])
def test_large_group(spark, monkeypatch, shard):
    """A group of near copies, among them chains, and as many texts with one long passage of it."""
    monkeypatch.setattr(jaccard, "SHARD_ROWS", shard)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 10 if shard == 20 else 200_000)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(base[:60] + [f"x{i}"] + base[61:])) for i in range(150)]
    rows += [(200 + i, " ".join(base[:60] + [f"y{i}-{k}" for k in range(60)])) for i in range(150)]
    rows += [(400 + i, " ".join([f"c{k}" for k in range(i, i + 60)])) for i in range(0, 60, 2)]
    rng.shuffle(rows)
    got = near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == Counter(slow_roots(rows))


def test_stage_keeps_no_near_copy(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert sorted(r.doc_id for r in cp.drop_near_copies(spark, docs, sf).collect()) == [i for i, c in slow_roots(rows) if i == c]


def test_bitmaps_never_rule_a_similar_pair_out():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.choice([1, 5, 60, 400, 3000])
        x = np.unique(np.array(rng.sample(range(1 << 62), n), np.uint64))
        y = np.unique(np.concatenate([x[rng.randrange(max(1, n // 5)) :], np.array(rng.sample(range(1 << 62), rng.randrange(n // 5 + 1)), np.uint64)]))
        exact = len(x) + len(y) - 2 * len(np.intersect1d(x, y))
        assert jaccard.apart(jaccard.bitmap(x), jaccard.bitmap(y)) <= exact
        other = np.array(rng.sample(range(1 << 62), max(20, n)), np.uint64)
        if n >= 60:
            assert jaccard.apart(jaccard.bitmap(x), jaccard.bitmap(other)) > (len(x) + len(other)) / 9
