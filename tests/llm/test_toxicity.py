import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netsets.llm.boosting import fit_isotonic, fit_trees
from netsets.llm.toxicity import FEATURES, MASKED, Featurizer, fit, terms_of, toxicity, with_toxicity


def corpus(n=700, seed=0):
    rng = random.Random(seed)
    pool = ["".join(rng.choices("abcdefgh", k=rng.randrange(3, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words, toxic = rng.choices(pool, k=rng.choice([3, 60, 300])), rng.random() < 0.25
        if toxic:
            words[:: max(1, len(words) // 5)] = [rng.choice(["idiot", "zyxx" + rng.choice(pool), "Zyxxu"]) for _ in words[:: max(1, len(words) // 5)]]
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def frames(spark, docs, labels):
    d = spark.createDataFrame([(*r, 1.0, 2, "x") for r in docs], "doc_id long, text string, score double, fold int, toxic string")
    return d.repartition(3), spark.createDataFrame([(*r, "t") for r in labels], "doc_id long, toxic int, text string")


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = corpus()
    odd = [(None, "no id"), (5000, None), (5001, ""), (5002, "idiot " * 50_000), (5003, "x"), (5003, "x")]
    d, lab = frames(spark, docs + odd, labels + [(3, None), (None, 1), (9999, 1)])
    got = toxicity(d, lab).collect()
    assert len(got) == len(docs) + len(odd)
    known = dict(labels)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in known]
    assert sum(r.predicted == known[r.doc_id] for r in held) >= 0.97 * len(held)
    again = {(r.doc_id, r.score) for r in toxicity(d.repartition(5), lab).collect()}
    assert again == {(r.doc_id, r.score) for r in got}


def test_held_out_labels_teach_nothing(spark):
    docs, labels = corpus(300, 1)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    d, lab = frames(spark, docs, labels)
    _, other = frames(spark, docs, flipped)
    assert {tuple(r) for r in toxicity(d, lab).collect()} == {tuple(r) for r in toxicity(d, other).collect()}


def test_few_labels_and_empty(spark):
    d, lab = frames(spark, [(1, "a"), (2, "b")], [(2, 1)])
    assert {r.score for r in toxicity(d, lab).collect()} <= {0.0, 1.0}
    assert toxicity(d.limit(0), lab).collect() == []
    kept = with_toxicity(d, fit(d, lab), score_col="tox")
    assert kept.columns == [*d.columns, "tox"] and kept.count() == 2


def test_features():
    f = Featurizer({"zyx*": 1.0, "zyxx*": 2.0})
    row = dict(zip(FEATURES, f("You are an IDIOT! zyxxab id10t?".encode()), strict=True))
    assert row["stated_count"] == 1 and row["learned_count"] == 1 and row["learned_top"] == 2.0
    assert row["near_second"] > 0 and row["unmasked_count"] == 1 and row["exclaim_rate"] > 0
    assert len(f(b"")) == len(FEATURES)


def test_boosting_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    margin = fit_trees(x, y).margin(x)
    assert ((margin > 0) == (y > 0)).mean() > 0.97
    p = 1 / (1 + np.exp(-x[:, 0] * 3))
    iso = fit_isotonic(x[:, 0], (rng.random(2000) < p).astype(float))
    assert (np.diff(iso.value) >= 0).all() and abs(iso(x[:, 0]) - p).mean() < 0.06


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "Bc", "1", "4@", "!", ".", "-", "*", " ", "é", "d#f", "3"]), max_size=14).map("".join))
def test_masked_words_as_the_plain_pattern(text):
    plain = re.compile(rb"[A-Za-z]+[*@$!013457#%.-]+[A-Za-z][A-Za-z*@$!013457#%]*")
    assert MASKED.findall(text.encode()) == plain.findall(text.encode())


@pytest.mark.parametrize("text", [b"a" * 1_000_000, b"a1" * 500_000, b"a" + b"1" * 1_000_000, b"a." * 500_000])
def test_long_runs_take_linear_time(text):
    began = time.monotonic()
    Featurizer({})(text)
    assert time.monotonic() - began < 3


@pytest.mark.parametrize("length", [39, 40, 41, 257, 1000, 100_000])
def test_learned_words_of_any_length(length):
    word = b"q" * length
    term = max(terms_of({word}), key=len)
    assert term == word.decode()
    assert Featurizer({term: 1.5}).weight(word) == 1.5 and Featurizer({term: 1.5}).weight(word + b"z") == 0


def test_hits_in_any_number():
    rows = [dict(zip(FEATURES, Featurizer({"zyxx*": 2.0})(b"idiot zyxxab " * n), strict=True)) for n in (10, 100, 1000)]
    assert [r["stated_count"] for r in rows] == [10, 100, 1000] and [r["learned_sum"] for r in rows] == [20, 200, 2000]


def test_without_labels_texts_are_still_told_apart(spark):
    d, lab = frames(spark, [(1, "you stupid idiot"), (2, "a kind word for all of you"), (3, ""), (4, None), (5, "what an 1d10t, id1ot you")], [(2, 1)])
    got = {r.doc_id: r.predicted for r in toxicity(d, lab.limit(0)).collect()}
    assert got == {1: 1, 2: 0, 3: 0, 4: 0, 5: 1}
