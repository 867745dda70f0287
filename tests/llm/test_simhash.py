import random

import numpy as np
import pytest
import xxhash

from netsets.llm import simhash
from netsets.llm.bitslice import group_links
from netsets.llm.simhash import components, fingerprint, near_duplicates, near_links


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(fps, radius=2):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def clustered(rng, n):
    out = {}
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 3, 90])):
            out[x] = None
            for _ in range(rng.choice([0, 1, 2, 3])):
                x ^= 1 << rng.randrange(64)
    return list(out)[:n]


def test_fingerprints():
    rng = random.Random(0)
    texts = ["", " \t\n", "One", "one TWO", "a b c", "Ä É b c d\x1ce f g"] + [" ".join(rng.choices("ab cD Ef gh".split(), k=k)) for k in range(40)]
    assert [fingerprint(t.encode()) for t in texts] == [slow_fingerprint(t) for t in texts]
    long = " ".join(str(i % 977) for i in range(40_000))
    assert fingerprint(long.encode()) == slow_fingerprint(long)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_sliced_groups(radius):
    rng = random.Random(radius)
    values = clustered(rng, 700)
    group = sorted(rng.choices([0, 0, 0, 1, 2, 3, 4, 5, 6], k=700))
    member, root = group_links(np.array(values, np.uint64), np.array(group), radius)
    got = list(range(700))
    for m, r in zip(member, root, strict=True):
        got[m] = r
    for g in set(group):
        at = [i for i in range(700) if group[i] == g]
        assert [at[x] for x in slow_components([values[i] for i in at], radius)] == [got[i] for i in at]


@pytest.mark.parametrize("bucket, finish", [(2048, 200_000), (1, 200_000), (2048, 0), (2048, 40)])
def test_links_with_and_without_refinement(spark, monkeypatch, bucket, finish):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "FINISH_LINKS", finish)
    values = clustered(random.Random(9), 400)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    rows = spark.createDataFrame(list(zip(signed, range(400), strict=True)), "fp long, rep long")
    got = dict(tuple(r) for r in components(near_links(rows)).collect())
    assert [got.get(i, i) for i in range(400)] == slow_components(values)


def test_documents(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choices([f"w{i}" for i in range(300)], k=rng.choice([2, 30, 400]))) for _ in range(30)]
    texts = [None, "", "  "] + base + [b + " Tail" for b in base] + [b.upper() for b in base] + ["x " * 100_000]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, 5, 6) for r in rows], "doc_id long, text string, fp long, rep long").repartition(3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(docs).collect()}
    by_id = sorted(rows)
    fps = [slow_fingerprint(t) for _, t in by_id]
    want = {i: (f"{f:016x}", by_id[c][0]) for (i, _), f, c in zip(by_id, fps, slow_components(fps), strict=True)}
    assert got == want


def test_null_and_repeated_ids_and_empty(spark):
    texts = ["alpha beta gamma delta", "one two three four five", "x y z w v"]
    rows = [(4, texts[0]), (4, texts[1]), (2, texts[1]), (None, texts[2]), (None, texts[2]), (7, texts[0]), (7, texts[0])]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got) == sorted([("4", 2), ("4", 2), ("2", 2), ("7", 2), ("7", 2), ("None", None), ("None", None)], key=str)
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_null_ids_do_not_join_what_they_stand_beside(spark):
    """Two rows without an id, each near another document: the documents stay apart, as in a search over all pairs."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    near = []
    while len(near) < 3:
        text = " ".join(rng.choices(words, k=900))
        other = text + " " + rng.choice(words)
        if 0 < (slow_fingerprint(text) ^ slow_fingerprint(other)).bit_count() <= 2:
            near.append((text, other))
    (a, near_a), (b, near_b), (c, near_c) = near
    rows = [(5, a), (None, near_a), (9, b), (None, near_b), (None, c), (None, near_c), (12, "far away from all of them")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    fps = [slow_fingerprint(t) for _, t in rows]
    of = slow_components(fps)
    want = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [d for j, (d, _) in enumerate(rows) if of[j] == of[i] and d is not None]
        want.append((str(doc_id), f"{fps[i]:016x}", min(ids, default=None)))
    assert sorted(((str(r.doc_id), r.fingerprint, r.component_id) for r in got), key=str) == sorted(want, key=str)
    assert {r.doc_id: r.component_id for r in got if r.doc_id} == {5: 5, 9: 9, 12: 12}


@pytest.mark.parametrize("finish", [0, 30, 200_000])
def test_components_of_a_long_path_and_a_star(spark, monkeypatch, finish):
    monkeypatch.setattr(simhash, "FINISH_LINKS", finish)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, 501 + i) for i in range(50)] + [(7, 7)]
    random.Random(0).shuffle(links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 551)}}
