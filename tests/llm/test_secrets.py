import hashlib
import random
import re
import string
import time
from math import log10

import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from netsets.llm import guesses
from netsets.llm.guesses import Guesser, guess_cost, ranked, vocabulary_words
from netsets.llm.secrets import base_spans, joined, scan, secrets

WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
VALUE = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
LOWER = {chr(c): chr(c + 32) for c in range(65, 91)}


def slow_assign(t):
    low, out, at = "".join(LOWER.get(c, c) for c in t), [], 0
    while at < len(t):
        best = None
        for w in WORDS:
            if low.startswith(w, at):
                i = at + len(w)
                for quote in (1, 0):  # an optional quote is taken if that leads to a match
                    j = i + 1 if quote and t[i : i + 1] in ("'", '"') and t[i : i + 1] else i
                    while t[j : j + 1] == " ":
                        j += 1
                    if t[j : j + 1] and t[j] in ":=":
                        j += 1
                        while t[j : j + 1] == " ":
                            j += 1
                        if t[j : j + 1] and t[j] in "'\"":
                            j += 1
                        k = j
                        while t[k : k + 1] and t[k] in VALUE:
                            k += 1
                        if k > j and best is None:
                            best = (at, 0, k, k - j)
                    if best:
                        break
            if best:
                break
        if best:
            if best[3] >= 6:
                out.append(best[:3])
            at = best[2]
        else:
            at += 1
    return out


def slow(t):
    out = slow_assign(t)
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


PARTS = ["password", "PassWord", "token", "api_key", "apikey", "APIKEY", "secreT", "paſſword", "toKen", " ", "  ", "=", ":", "'", '"', "abcdef", "a", "Zz9+/_.", "AKIA", "AKIA" + "Q7" * 8, "0" * 23, "deadbeef" * 3, "é", "\n", "pwd", "://u:", "@h"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
@example("token = \"'abcdefg")
def test_base_spans(text):
    assert base_spans(text) == slow(text)
    base, spans, costs = scan(text, guess_cost)
    assert set(base) <= set(spans) and len(costs) == len(spans)


def test_rows(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choices(PARTS, k=rng.randrange(30)))) for i in range(200)] + [(900, None), (901, ""), (None, "token=abcdef"), (3, "x"), (902, "x " * 200_000 + "token: abcdefg")]
    docs = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, n_hex int, spans string").repartition(3)
    got = secrets(docs).collect()
    want = []
    for i, t in rows:
        b = slow(t or "")
        want.append((str(i), *[sum(k == x for _, k, _ in b) for x in range(3)], hashlib.sha256(joined(b).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == sorted(want)
    assert all(f.value == dict(rows)[r.doc_id][f.start : f.end] for r in got for f in r.found if dict(rows)[r.doc_id] and r.doc_id != 3)
    assert all(f.value is None for r in secrets(docs, values=False).collect() for f in r.found)
    assert secrets(docs.limit(0)).collect() == []


def test_guess_costs():
    for weak in ("password", "P4ssw0rd", "drowssap", "aaaaaaaaaaaa", "qwertyuiop", "19840312", "2020-01-02", "abcdefgh", "password123", "xy7xy7xy7xy7"):
        assert guess_cost(weak) < 7.5, weak
    for strong in ("k9#Vt2!qLm", "b7db7aa4a5fcc78305", "Zq8vN3xR7wYp"):
        assert guess_cost(strong) > 10, strong
    once = guess_cost("Zq8vN3xR7wYp")
    assert guess_cost("") == 0 and once < guess_cost("Zq8vN3xR7wYp" * 100) < once + log10(1200) + 0.31  # a repeat adds the logarithm of its length
    text = "my pwd is k9#Vt2!qLm, her passphrase: password and http://u:xK93_vbQz@h"
    assert [s for s in joined(scan(text, guess_cost)[1]).split(",") if s] == [f"guess:{text.index('k9#')}:{text.index(', her')}", f"guess:{text.index('xK9')}:{text.index('@h')}"]


def slow_cost(value, rank):
    """Every part of every kind at every place."""
    n = len(value)
    size = lambda c: 10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100
    low = value.lower()
    row = {c: r for r, keys in enumerate(guesses.ROWS) for c in keys}

    def parts(a, b):
        part, lower = value[a:b], low[a:b]
        yield sum(log10(size(c)) for c in part) + (guesses.SPAN if b - a > 1 else 0)
        if b - a >= 3:
            if len(set(part)) == 1:
                yield log10(size(part[0])) + log10(b - a)
            steps = {ord(y) - ord(x) for x, y in zip(part, part[1:], strict=False)}
            if steps in ({1}, {-1}):
                yield log10(size(part[0])) + log10(b - a)
            if all(guesses._beside(x, y) for x, y in zip(lower, lower[1:], strict=False)):
                yield log10(47) + log10(b - a) + sum(guesses.TURN for x, y in zip(lower, lower[1:], strict=False) if row[x] != row[y])
            word = guess.word_cost(part, lower, lower.translate(guesses.STANDS_FOR))
            if word is not None:
                yield word
        if 4 <= b - a <= 10 and part[0].isdigit() and part[-1].isdigit():
            date = guesses.date_cost(part)
            if date is not None:
                yield date
        for period in range(2, b - a + 1):  # what stands before is said again, once or more
            if period <= a and all(value[i] == value[i - period] for i in range(a, b)):
                yield log10(b - a)

    guess = Guesser(rank)
    best = [0.0]
    for b in range(1, n + 1):
        best.append(min(best[a] + guesses.PART + c for a in range(b) for c in parts(a, b)))
    return best[n]


BITS = ["pass", "word", "drow", "aaaa", "a", "qwe", "asdf", "1984", "12", "-", "abc", "x7K", "x7Kx7K", "P4ss", "é", "zyx", "!"]


@settings(max_examples=250, deadline=None)
@given(st.lists(st.sampled_from(BITS), min_size=1, max_size=7).map("".join))
@example("aaaaaaaaaaaab")
@example("x7Kqx7Kqx7Kqx7Kqx7Kq")
@example("abxababxababxab")
@example("passworddddddd")
@example("qwertyuioppoiuytrewq")
def test_costs_by_trying_all_parts(value):
    rank = {"password": 1, "pass": 7, "word": 40, "qwerty": 5}
    assert Guesser(rank)(value) == pytest.approx(slow_cost(value, rank))


@pytest.mark.parametrize("length", [255, 256, 257, 300, 1000, 100_000])
def test_any_length(length):
    began = time.monotonic()
    assert guess_cost("a" * length) <= guess_cost("a" * 250) + log10(length / 250) + 0.01
    assert guess_cost(("x7Kq" * length)[:length]) <= guess_cost("x7Kq") + log10(length) + 1
    assert guess_cost("-" * length) < guesses_needed()
    assert time.monotonic() - began < 60
    strong = "".join(random.Random(1).choices(string.ascii_letters + string.digits, k=min(length, 5000)))
    assert guess_cost(strong) > len(strong)


def guesses_needed():
    from netsets.llm.secrets import MIN_GUESSES

    return MIN_GUESSES


def test_words_of_vocabularies():
    lists = [vocabulary_words(public_tokenizers.path(name)) for name in ("word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken")]
    guess = Guesser(ranked(*lists))
    prose = "password is incorrect. login is required! the secret is patience, auth: available; Authorization is mandatory, the login is described below; a token is represented by"
    assert not [k for _, k, _ in scan(prose, guess)[1] if k == 3]
    with pytest.raises(ValueError):
        ranked(map(str, range(guesses.MOST_WORDS + 1)))


def test_values_that_reach_beyond_base_spans():
    text = "password=summer!Zq8$vN3xR7 pwd=secret-summer token: abcdef"
    base, spans, costs = scan(text, guess_cost)
    assert joined(base) == joined([s for s in spans if s[1] != 3])
    a = text.index("summer!")
    assert [s for s in spans if s[1] == 3] == [(a, 3, text.index(" pwd"))]
    whole = "auth=x0123456789abcdef0123456789abcdef!Zq"
    assert (5, 3, len(whole)) in scan(whole, guess_cost)[1] and any(k == 2 for _, k, _ in scan(whole, guess_cost)[0])


def test_columns_of_costs(spark):
    docs = spark.createDataFrame([(1, "pwd is k9#Vt2!qLm and token=abcdef"), (2, None)], "doc_id long, text string")
    one, two = sorted(secrets(docs).collect())
    assert (one.n_guess, two.n_guess, two.guesses, two.spans) == (1, 0, "", "")
    assert [f"{f.log10_guesses:.2f}" for f in one.found] == one.guesses.split(",") and len(one.found) == len(one.spans.split(","))
