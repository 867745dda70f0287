"""Personal data: patterns propose spans, checksums confirm them, context words adjust their score.

Base spans are email, ip, card and phone, as stated below. The method adds `iban` (mod-97 confirmed) and `ssn` (area, group and
serial must be issued ones, and a context word must stand near). Every span has a score from its kind, its checksum and the words
within NEAR characters; added spans need MIN_SCORE, base spans stay at any score. All patterns take linear time on any text: no
digit run is entered twice, and an email is found from its @, going back no further than the last match or @.

Defined cases: null or empty text has no spans; texts are scanned whole, in code points; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsets.llm.common import map_batches, text_of

# The base patterns, in the order in which kinds are listed, then the added ones. An email is LOCAL, @ and HOST.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = 4
# Score of a confirmed span without context, and words that raise or lower it.
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
FOR = {
    "email": ("mail", "contact", "write", "reach", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "login", "adresse"),
    "card": ("card", "visa", "credit", "mastercard", "amex", "payment", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "whatsapp", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "account", "bank", "transfer", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social", "security"),
}
AGAINST = ("example", "sample", "test", "version", "isbn", "order", "serial", "part")
RAISE, LOWER, NEAR, MIN_SCORE = 0.25, 0.15, 40, 0.5
WORD = re.compile(r"\w+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _card(s: str) -> bool:
    if not 16 <= len(s) <= 37:  # at most 19 digits, with 18 marks between them
        return False
    digits = _digits(s)
    return 16 <= len(digits) <= 19 and luhn(digits)


def emails(text: str) -> list[tuple[int, int]]:
    """(start, end), leftmost and non-overlapping."""
    out, low = [], 0
    at = text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(LOCAL))
        host = HOST.match(text, at + 1) if start < at else None
        # what an email took can't begin the next one; nor can anything before an @ that no email has
        low = host.end() if host else at + 1
        if host:
            out.append((start, low))
        at = text.find("@", low)
    return out


def _ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def _ssn(s: str) -> bool:
    area, group, serial = s.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), by kind as listed, then start."""
    out = []
    if "@" in text:
        out += [(0, a, b) for a, b in emails(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if _ip(m[0])]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(text) if _card(m[0])]
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def score(text: str, kind: int, start: int, end: int) -> float:
    name = KINDS[kind]
    around = set(WORD.findall((text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]).lower()))
    near = any(w.startswith(FOR[name]) for w in around)
    against = any(w in AGAINST for w in around)
    return max(0.0, min(1.0, PRIOR[name] + RAISE * near - LOWER * against))


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], list[float]]:
    """Base spans, all spans, and the score of each of all; sorted by kind, then start."""
    base = base_spans(text)
    added = []
    at = 0
    while m := IBAN.search(text, at):
        # white space may have joined what follows: the longest confirmed beginning at a space or the end is it
        ends = [i for i in range(m.start() + 15, m.end() + 1) if i == m.end() or text[i] == " "]
        end = next((e for e in reversed(ends) if 15 <= len(raw := text[m.start() : e].replace(" ", "")) <= 34 and mod97(raw)), 0)
        if end:
            added.append((4, m.start(), end))
        at = end or m.start() + 1  # another may begin inside a match that is not confirmed, or after the confirmed part of one
    added += [(5, m.start(), m.end()) for m in SSN.finditer(text) if _ssn(m[0])]
    scored = [(s, score(text, *s)) for s in base] + [(s, x) for s in added if (x := score(text, *s)) >= MIN_SCORE]
    return base, [s for s, _ in scored], [x for _, x in scored]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("score", pa.float64())]))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", values: bool = True) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_iban, n_ssn, scores (of each of the spans, two
    places, joined likewise), found (kind, start, end, value, score)."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in batch.column(1):
                text = text.as_py()
                base, spans, scores = scan(text)
                counts = [sum(k == kind for k, _, _ in base) for kind in range(BASE)]
                found = [{"kind": KINDS[k], "start": a, "end": b, "value": text[a:b] if values else None, "score": x} for (k, a, b), x in zip(spans, scores, strict=True)]
                more = [sum(k == kind for k, _, _ in spans) for kind in range(BASE, len(KINDS))]
                listed = ",".join(f"{x:.2f}" for x in scores)
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), *more, listed, found))
            kinds = (*[pa.int64()] * BASE, pa.string(), pa.string(), *[pa.int64()] * len(KINDS[BASE:]), pa.string(), FOUND)
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            return pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_iban", "n_ssn", "scores", "found"])

        return step

    schema = (
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_iban long, n_ssn long, scores string, "
        "found array<struct<kind:string,start:bigint,end:bigint,value:string,score:double>>"
    )
    return map_batches(docs.select(F.col(id_col).cast("long"), text_of(text_col)), make, schema)
