import random
from collections import defaultdict
from math import ceil, floor, sqrt

import pytest

from netsets.llm.mixing import mix

WEIGHTS = (5, 2, 1)


def targets(sizes, share=1.5, repeat=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(order)}
    full, total = set(), share * sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        words = total - sum(repeat * sizes[s] for s in full)
        fair = {s: weight[s] * words / sum(weight[x] for x in rest) for s in rest}
        more = {s for s in rest if fair[s] > repeat * sizes[s]}
        if not more:
            return {s: repeat * sizes[s] if s in full else fair[s] for s in order}
        full |= more


def expected_copies(rows, target, repeat=2):
    """(size, own weight) -> copies in proportion to the weight, none above `repeat`, with `target` words in all where that can be."""
    low, high = 0.0, 1e9
    for _ in range(200):
        rate = (low + high) / 2
        if sum(size * min(repeat, rate * own) for size, own in rows) < target:
            low = rate
        else:
            high = rate
    return [min(repeat, high * own) for _, own in rows]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, target string")


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_words(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.choice([1, 5, 40, 300]), rng.choice(["hot"] * 5 + ["b", "a", None, "é", "zz"])) for i in range(600)]
    rows += [(1000, None, "a"), (1001, "", "nothing"), (1002, "  \t", "nothing")]
    got = mix(frame(spark, rows)).collect()
    again = mix(frame(spark, rows).repartition(7)).collect()
    assert len(got) == len(rows)
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes)
    for s, size in sizes.items():
        own = [r for r in got if r.source == s]
        assert {r.source_size for r in own} == {size}
        assert own[0].target == pytest.approx(want[s])
        assert abs(sum(r.taken for r in own) - want[s]) <= 150.5  # half of the longest text
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    for s in sizes:  # whole copies are certain, and at most one more is drawn
        own = [r for r in got if r.source == s]
        want_copies = expected_copies([(r.size, r.size.bit_length()) for r in own], want[s])
        assert all(floor(c + 1e-9) <= r.copies <= ceil(c - 1e-9) for r, c in zip(own, want_copies, strict=True) if r.size)


def test_repeated_rows_empty_and_weights(spark):
    rows = [(7, "a b", "s")] * 9 + [(None, "c d", "s"), (8, "e f", "t")]
    got = mix(frame(spark, rows)).collect()
    assert len(got) == 11 and all(r.taken <= 4 for r in got)
    assert mix(frame(spark, [])).collect() == []
    weighed = spark.createDataFrame([(i, "a b c", "s", float(i % 2)) for i in range(100)], "doc_id long, text string, source string, q double")
    got = mix(weighed, weight_col="q", share=0.5).collect()
    assert sum(r.taken for r in got) == 150 and {r.doc_id % 2 for r in got if r.taken} == {1}


def test_inclusion_frequencies_with_unequal_odds(spark):
    """Many sources of the same documents with different ids: how often a document is taken is what its weight asks for."""
    sources, sizes = 400, [10, 10, 10, 10, 10, 10, 10, 10, 10, 10, 10, 10]
    own = [1.0, 1.0, 1.0, 1.0, 2.0, 2.0, 2.0, 3.0, 3.0, 5.0, 5.0, 40.0]
    rows = [(s * 100 + i, "w " * n, f"s{s:03}", w) for s in range(sources) for i, (n, w) in enumerate(zip(sizes, own, strict=True))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, q double")
    got = mix(docs, weight_col="q", share=0.6, weights=(1,)).collect()
    want = expected_copies(list(zip(sizes, own, strict=True)), 0.6 * sum(sizes))
    assert max(want) == 2 and len({round(c, 6) for c in want}) == 5
    per_source, taken = defaultdict(int), defaultdict(list)
    for r in got:
        per_source[r.source] += r.taken
        taken[own[r.doc_id % 100]].append(r.copies)
    assert all(abs(words - 72) <= 5 for words in per_source.values())
    for w, c in zip(own, want, strict=True):
        seen = taken[w]
        assert set(seen) <= {floor(c), ceil(c)}
        spread = sqrt(max(c % 1 * (1 - c % 1), 0.001) / len(seen))
        assert abs(sum(seen) / len(seen) - c) <= 4 * spread + 0.02, w


def test_weights_that_are_missing_or_odd(spark):
    rows = [(1, "a b", "s", None), (2, "a b", "s", -1.0), (3, "a b", "s", float("nan")), (4, "a b", "s", 2.0), (5, "a b", "t", 0.0), (6, "", "t", 1.0)]
    got = {r.doc_id: r.copies for r in mix(spark.createDataFrame(rows, "doc_id long, text string, source string, q double"), weight_col="q").collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 2, 5: 0, 6: 0}


def test_a_source_without_ids(spark):
    rows = [(None, f"{i} b c", "s") for i in range(500)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=0.5).collect()
    assert sum(r.taken for r in got) == 750 and {r.copies for r in got} == {0, 1}
