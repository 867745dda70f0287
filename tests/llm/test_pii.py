import hashlib
import random
import re
import time

import pytest

from hypothesis import given, settings
from hypothesis import strategies as st

from netsets.llm.pii import base_spans, joined, luhn, mod97, personal_data, scan

LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = LOCAL - set("._%+")
DIGIT = set("0123456789")


def slow_emails(t):
    out, at = [], 0
    while at < len(t):
        i = at
        while i < len(t) and t[i] in LOCAL:
            i += 1
        if i > at and t[i : i + 1] == "@":
            j = i + 1
            while j < len(t) and t[j] in HOST:
                j += 1
            end = None
            if j > i + 1:
                while t[j : j + 1] == "." and t[j + 1 : j + 2] and t[j + 1] in HOST:
                    j += 1
                    while j < len(t) and t[j] in HOST:
                        j += 1
                    end = j
            if end:
                out.append((0, at, end))
                at = end
                continue
        at += 1
    return out


def slow_cards(t):
    out, at = [], 0
    while at < len(t):
        if t[at] not in DIGIT:
            at += 1
            continue
        j = at + 1
        while True:
            if t[j : j + 1] and t[j] in DIGIT:
                j += 1
            elif t[j : j + 1] and t[j] in " -" and t[j + 1 : j + 2] and t[j + 1] in DIGIT:
                j += 2
            else:
                break
        if j > at + 1:
            d = [int(c) for c in t[at:j] if c in DIGIT]
            if 16 <= len(d) <= 19 and sum(sum(divmod(x * (1 + k % 2), 10)) for k, x in enumerate(reversed(d))) % 10 == 0:
                out.append((2, at, j))
        at = j
    return out


def slow(t):
    ips = [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    phones = [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c in DIGIT for c in m[0]) <= 15]
    return slow_emails(t) + ips + slow_cards(t) + phones


PARTS = ["a", "b.c", "@", ".", "x@y.de", "+", "-", "1", "255", "256", "10.0.0.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123-456", "+1", " ", "(", "é", "٣", "%", "00000000000000000"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join))
def test_base_spans(text):
    assert base_spans(text) == slow(text)
    base, spans, scores = scan(text)
    assert spans[: len(base)] == base and len(scores) == len(spans) and all(0 <= x <= 1 for x in scores)


def test_checksums_and_context():
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    assert mod97("DE89370400440532013000") and not mod97("DE88370400440532013000")
    text = "pay to IBAN DE89 3704 0044 0532 0130 00 NOW, ssn 123-45-6789; not 123-45-6780 alone " + "." * 60 + " 123-45-6781 GB82WEST12345698765432"
    kinds = [(s.split(":")[0], text[int(s.split(":")[1]) : int(s.split(":")[2])]) for s in joined(scan(text)[1]).split(",")]
    assert ("iban", "DE89 3704 0044 0532 0130 00") in kinds and ("iban", "GB82WEST12345698765432") in kinds
    assert ("ssn", "123-45-6789") in kinds and ("ssn", "123-45-6781") not in kinds
    near, far = scan("my card is 4111 1111 1111 1111")[2], scan("zz 4111 1111 1111 1111")[2]
    assert near[0] > far[0]


def test_rows(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choices(PARTS, k=rng.randrange(25)))) for i in range(200)] + [(900, None), (901, ""), (None, "x@y.de"), (3, "x"), (902, "x " * 200_000 + "x@y.de")]
    docs = spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, n_ip int, spans string").repartition(3)
    got = personal_data(docs).collect()
    want = []
    for i, t in rows:
        b = slow(t or "")
        want.append((str(i), *[sum(k == x for k, _, _ in b) for x in range(4)], hashlib.sha256(joined(b).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == sorted(want)
    assert personal_data(docs.limit(0)).collect() == []


def test_ibans_that_a_match_runs_over():
    one, two = "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19"
    for text, want in ((f"{one} {two} {one}", [one, two, one]), (f"AB12 {one}", [one]), (f"AB12 CD34 {two}, AB12", [two])):
        assert [text[a:b] for k, a, b in scan(text)[1] if k == 4] == want


# the patterns as the contract states them
PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain(t):
    """The stated patterns as they stand, and the stated checks."""
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, t):
            digits = [int(c) for c in m[0] if c in DIGIT]
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2 and not (16 <= len(digits) <= 19 and sum(sum(divmod(x * (1 + k % 2), 10)) for k, x in enumerate(reversed(digits))) % 10 == 0):
                continue
            if kind == 3 and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


CLOSE = ["a@b.c", "@", "@a", "a", ".", "b-", "1.2.3.4", "5.6.7.8", "1", "9.", " ", "-", "x@y", "@z.de", "%", "é", "a@b.c@d.e", "+1"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(CLOSE), max_size=14).map("".join))
def test_same_as_the_plain_patterns(text):
    assert base_spans(text) == plain(text)


@pytest.mark.parametrize("text", ["1" * 1_000_000, "a" * 1_000_000 + "@b.c", "a" * 999_999 + " @", "@".join("a" * 1000 for _ in range(1000)), "1." * 500_000, "1 " * 500_000, "+1" + "(" * 1_000_000, "A1" * 500_000, "DE89 " * 40_000], ids=range(9))
def test_long_texts_take_linear_time(text):
    began = time.monotonic()
    scan(text)
    assert time.monotonic() - began < 5  # well under a second where nothing else runs; quadratic time would be hours


def slow_added(t):
    """Spans of ibans and numbers, found at every place by their definition, with the words around them."""
    out, at = [], 0
    word = lambda c: c.isascii() and c.isalnum()
    while at < len(t):
        end = 0
        if not (at and word(t[at - 1])) and re.match("[A-Z]{2}[0-9]{2}", t[at:]):
            longest, j, n = None, at + 4, 0
            while n < 30:  # characters, each perhaps after one space; the longest that no word character follows
                k = j + 1 if t[j : j + 1] == " " else j
                if not (t[k : k + 1] and t[k].isascii() and (t[k].isdigit() or t[k].isupper())):
                    break
                j, n = k + 1, n + 1
                if n >= 11 and not (t[j : j + 1] and word(t[j])):
                    longest = j
            for e in range(longest or 0, at + 14, -1):
                raw = t[at:e].replace(" ", "")
                if (e == longest or t[e] == " ") and 15 <= len(raw) <= 34 and mod97(raw):
                    end = e
                    break
        if end:
            out.append((4, at, end))
        at = end or at + 1
    for m in re.finditer(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", t):
        a, b = m.span()
        area, group, serial = m[0].split("-")
        free = (not a or t[a - 1] not in "0123456789-") and (b == len(t) or t[b] not in "0123456789-")
        if free and area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            out.append((5, a, b))
    return out


ADDED = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "GB29 NWBK 6016 1331 9268 19", "DE88", "AB12", " ", "x", "ssn ", "123-45-6789", "666-12-1234", "iban", "9", "-", "test ", "é", ". " * 30]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ADDED), max_size=9).map("".join))
def test_added_spans_and_scores(text):
    base, spans, scores = scan(text)
    found = {}
    for kind, a, b in slow_added(text):
        around = re.findall(r"\w+", text[max(0, a - 40) : a].lower()) + re.findall(r"\w+", text[b : b + 40].lower())
        near = any(w.startswith(("iban", "account", "bank", "transfer", "konto", "cuenta", "compte") if kind == 4 else ("ssn", "social", "security")) for w in around)
        against = any(w in ("example", "sample", "test", "version", "isbn", "order", "serial", "part") for w in around)
        score = min(1.0, (0.8 if kind == 4 else 0.3) + 0.25 * near - 0.15 * against)
        if score >= 0.5:
            found[kind, a, b] = score
    assert spans[: len(base)] == base
    assert dict(zip(spans[len(base) :], scores[len(base) :], strict=True)) == pytest.approx(found)


def test_columns_of_scores(spark):
    docs = spark.createDataFrame([(1, "my card is 4111 1111 1111 1111, iban GB82WEST12345698765432, ssn 123-45-6789"), (2, None)], "doc_id long, text string")
    one, two = sorted(personal_data(docs).collect())
    assert (one.n_card, one.n_iban, one.n_ssn, two.n_iban, two.n_ssn, two.scores) == (1, 1, 1, 0, 0, "")
    assert [f"{f.score:.2f}" for f in one.found] == one.scores.split(",") and len(one.found) == 3
