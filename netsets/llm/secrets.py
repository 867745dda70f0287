"""Secret scan: stated patterns, and password guess cost for values that stand where credentials stand.

Base spans are assign, access and hex, as stated below. The method looks at whole values in credential contexts (key words, URLs
with a password, authorization headers) and adds a `guess` span where the cheapest segmentation of the value costs at least
MIN_GUESSES and no base span holds all of it; each assign span gets its value's cost too, as a score that removes nothing. Words
of the segmentation come from the stated list and from the tokenizer vocabularies whose paths are given, by their rank there.

Defined cases: null or empty text has no spans; texts are scanned and values costed whole, at any length; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsets.llm.common import map_batches, text_of
from netsets.llm.guesses import Guesser, ranked, vocabulary_words

# The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "guess")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
# What the method takes for a credential context besides the base patterns.
CONTEXT = re.compile(
    r"""(?ai:\b(?:pwd|pass|passphrase|passcode|credentials?|auth(?:orization)?|access[_-]?key|private[_-]?key|client[_-]?secret|login)\b["']?\x20*(?:[:=]|\bis\b)\x20*(?:(?:bearer|basic)\x20+)?["']?)([^\s"'<>]{6,})"""
    r"""|(?ai:(?:password|passwd|secret|token|api_?key)["']?\x20*(?:[:=]|\bis\b)\x20*["']?)([^\s"'<>]{6,})"""
    r"""|://[^\s/:@"']+:([^\s/@"']{6,})@"""
)
#: log10 of the least guesses that make a value a secret.
MIN_GUESSES = 8.0

WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
MORE_WORDS = ("pwd", "pass", "credential", "auth", "access", "private", "login", "://")


def base_spans(text: str, low: str | None = None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, sorted."""
    low = text.lower() if low is None else low
    out = []
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def scan(text: str, guess: Guesser) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], list[float | None]]:
    """Base spans; all spans; and for each of all, log10 guesses of its value where it stands in a credential context."""
    low = text.lower()
    base = base_spans(text, low)
    spans = {s: None for s in base}
    for start, kind, end in base:
        if kind == 0:
            value = ASSIGN.match(text, start, end)
            spans[start, kind, end] = guess(value[2]) if value else None
    if any(w in low for w in WORDS) or any(w in low for w in MORE_WORDS):
        at = 0  # base spans before it end before the values still to come begin
        for m in CONTEXT.finditer(text):
            a, b = m.span(m.lastindex)
            while b > a and text[b - 1] in ".,;:!?)]}":
                b -= 1
            while at < len(base) and base[at][2] <= a:
                at += 1
            if b - a < LEAST_ASSIGN or any(x <= a and b <= y for x, _, y in base[at : at + len(KINDS)]):
                continue
            cost = guess(text[a:b])
            if cost >= MIN_GUESSES:
                spans[a, 3, b] = cost
    order = sorted(spans)
    return base, order, [spans[s] for s in order]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("log10_guesses", pa.float64())]))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", values: bool = True, vocabularies: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess, guesses (log10 guesses of each of the spans, two
    places, joined likewise; empty where a span has none), found (kind, start, end, value, log10_guesses). `vocabularies`: files of
    tokenizers that the driver reads. With values=False the texts of spans are left out of `found`, so that a report holds no secret."""
    shared = docs.sparkSession.sparkContext.broadcast(ranked(*map(vocabulary_words, vocabularies)))

    def make():
        guess = Guesser(shared.value)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in batch.column(1):
                text = text.as_py()
                base, spans, costs = scan(text, guess)
                counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                found = [{"kind": KINDS[k], "start": a, "end": b, "value": text[a:b] if values else None, "log10_guesses": c} for (a, k, b), c in zip(spans, costs, strict=True)]
                guesses = ",".join("" if c is None else f"{c:.2f}" for c in costs)
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base), guesses, found))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), FOUND)
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            return pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "guesses", "found"])

        return step

    schema = (
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, guesses string, "
        "found array<struct<kind:string,start:bigint,end:bigint,value:string,log10_guesses:double>>"
    )
    return map_batches(docs.select(F.col(id_col).cast("long"), text_of(text_col)), make, schema)
