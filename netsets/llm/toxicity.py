"""Toxicity: gradient-boosted trees over dense features of the whole text, with isotonic calibration.

Features are densities of a stated lexicon and of one learned from labels (words and word beginnings whose documents are
toxic more often than chance explains), their nearness to second-person words, and rates of capitals, punctuation and
obfuscation. Labels are learned only from rows outside the held-out fold (crc32 of the id as text, modulo FOLDS, is 0), and of
these from a hash sample of SAMPLE_ROWS expected rows: the documented bound. Each training row's features use a lexicon
learned without its fold, and calibration uses trees fitted without its fold.

Defined cases: null text counts as empty and is scored as such; a null label or id teaches nothing, and a null id is not held
out; several labels of one id count as their largest; with labels of fewer than MIN_EACH documents of either kind nothing is learned and
the score rises with the stated lexicon alone (see `unlearned`); an empty table gives an empty result; other columns pass by untouched.
Words count at any length, terms and hits in any number.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log, log1p, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsets.llm.boosting import Isotonic, Trees, fit_isotonic, fit_trees
from netsets.llm.common import cut, give_back, returning, small_batches, text_of

FOLDS = 5
SAMPLE_ROWS = 20_000
MIN_EACH = 10
#: Beginnings of words that the learned lexicon may hold, besides whole words.
BEGINNINGS = (4, 5, 6)
MIN_TOXIC_DOCS = 4
#: Least lower bound of a learned term's log odds, and its width in standard errors. The sample bounds how many terms can pass.
MIN_BOUND, ERRORS = 1.2, 1.64
#: Words between a hit and a second-person word that still count as near.
NEAR = 5
#: Without labels: words to one insult that make a text as likely toxic as not.
EVEN = 30

# Insults of the stated lexicon.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers pathetic worthless disgusting trash scum clown clowns imbecile fool fools "
    "garbage filth vermin coward freak creep pig pigs bastard jerk retard ugly hate shut sucks "
    "idiotin dumm dummkopf trottel arschloch abschaum ekelhaft "
    "estúpido estúpida imbécil basura asqueroso asquerosa tonto "
    "idiote imbécile stupide débile ordure dégoûtant connard minable".split()
)
# Second-person words.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch sie tú tu te ti usted ustedes vosotros vos toi ton ta tes vous votre vos".split())

FEATURES = (
    "log_words stated_density stated_count learned_density learned_count learned_top learned_sum near_second second_rate capital_rate "
    "exclaim_rate question_rate punctuation_rate symbol_rate obfuscated_rate unmasked_count digit_rate"
).split()

UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
PUNCTUATION = b".,;:'\"-()"
SYMBOLS = b"*@$#%&^~_|+="
#: Bytes that may stand in words, in small letters; the rest become spaces.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))
#: Letters, marks that may stand for letters, and letters again; entered once for each run of letters, so in linear time.
MASKED = re.compile(rb"(?<![A-Za-z])[A-Za-z]++[*@$!013457#%.-]++[A-Za-z][A-Za-z*@$!013457#%]*+")
UNMASK = bytes.maketrans(b"013457@$!", b"oieastasi")


def terms_of(words: set[bytes]) -> set[str]:
    out = set()
    for raw in words:
        word = raw.decode("utf-8", "ignore")
        if len(word) > 2:
            out.add(word)
            out.update(f"{word[:n]}*" for n in BEGINNINGS if len(word) >= n)
    return out


class Featurizer:
    def __init__(self, learned: dict[str, float]):
        self.learned = learned
        self.seen: dict[bytes, float] = {}
        self.stated = {w.encode() for w in INSULTS}
        self.second = {w.encode() for w in SECOND_PERSON}

    def weight(self, raw: bytes) -> float:
        held = self.seen.get(raw)
        if held is None:
            word = raw.decode("utf-8", "ignore")
            held = max((self.learned.get(t, 0.0) for t in (word, *(f"{word[:n]}*" for n in BEGINNINGS))), default=0.0) if len(word) > 2 else 0.0
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[raw] = held
        return held

    def __call__(self, text: bytes) -> list[float]:
        words = text.translate(WORD_BYTES).split()
        n, size = max(1, len(words)), max(1, len(text))
        unique = set(words)
        weights = {w: x for w in unique if (x := self.weight(w)) > 0}
        stated = unique & self.stated
        second = unique & self.second
        hits = stated.union(weights)
        near = n_stated = n_learned = n_second = 0
        total = 0.0
        if hits or second:
            last_hit = last_second = -NEAR - 1
            for i, w in enumerate(words):
                if w in second:
                    n_second += 1
                    near += i - last_hit <= NEAR
                    last_second = i
                if w in hits:
                    n_stated += w in stated
                    x = weights.get(w)
                    if x:
                        n_learned += 1
                        total += x
                    near += i - last_second <= NEAR
                    last_hit = i
        masked = [m.translate(UNMASK, b"*#%.-").lower() for m in MASKED.findall(text)]
        unmasked = sum(m in self.stated or self.weight(m) > 0 for m in masked)
        rate = lambda chars: (len(text) - len(text.translate(None, chars))) / size
        return [
            log1p(len(words)), n_stated / n, n_stated, n_learned / n, n_learned, max(weights.values(), default=0.0), total,
            near / n, n_second / n, rate(UPPER), text.count(b"!") / size, text.count(b"?") / size, rate(PUNCTUATION), rate(SYMBOLS),
            len(masked) / n, unmasked, rate(DIGITS),
        ]


@dataclass
class Model:
    learned: dict[str, float]
    trees: Trees | None
    calibration: Isotonic | None

    def scorer(self):
        featurize = Featurizer(self.learned)

        def score(texts: list[bytes]) -> np.ndarray:
            x = np.array([featurize(t) for t in texts], float).reshape(-1, len(FEATURES))
            if self.trees is None:
                return unlearned(x)
            return np.clip(self.calibration(self.trees.margin(x)), 0.0, 1.0)

        return score


def unlearned(x: np.ndarray) -> np.ndarray:
    """Scores without labels: a half where stated insults, masked ones among them, and second-person words near them are one word in EVEN."""
    column = {name: x[:, i] for i, name in enumerate(FEATURES)}
    words = np.maximum(np.expm1(column["log_words"]), 1.0)
    density = column["stated_density"] + column["near_second"] + column["unmasked_count"] / words
    return density / (density + 1 / EVEN)


def fold_of(id_col: str) -> Column:
    return F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % FOLDS


def _lexicon(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """(term, toxic documents, clean documents) -> lower bound of its log odds, for the terms that have a high one."""
    out = []
    for term, a, b in counts:
        if a >= MIN_TOXIC_DOCS:
            bound = log((a + 0.5) / (toxic + 1)) - log((b + 0.5) / (clean + 1)) - ERRORS * sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
            if bound >= MIN_BOUND:
                out.append((bound, term))
    return {term: bound for bound, term in sorted(out, reverse=True)}


def _bound(toxic_docs: Column, clean_docs: Column, toxic: int, clean: int) -> Column:
    a, b = toxic_docs + F.lit(0.5), clean_docs + F.lit(0.5)
    return F.log(a / F.lit(toxic + 1)) - F.log(b / F.lit(clean + 1)) - F.lit(ERRORS) * F.sqrt(1 / a + 1 / b)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold_of(id_col) != 0))
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    rows = known.count()
    share = min(1.0, sample_rows / max(rows, 1))
    drawn = F.pmod(F.xxhash64(F.lit("toxicity"), "id"), F.lit(1_000_003)) < F.lit(share * 1_000_003)
    # at most about sample_rows small rows, so broadcasting them is safe at any size, and no text is shuffled
    picked = F.broadcast(known.where(drawn).withColumn("fold", fold_of("id").cast("int")))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).join(picked, "id")
    small_batches(docs.sparkSession)
    texts = cut(texts.select("fold", "y", "text"))
    sizes = {(r.fold, r.y): r["count"] for r in texts.groupBy("fold", "y").count().collect()}
    total = [sum(n for (_, y), n in sizes.items() if y == k) for k in (0, 1)]
    if min(total) < MIN_EACH:
        return Model({}, None, None)

    def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for fold, y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                counts.update((t, fold, y) for t in terms_of(set(text.as_py().translate(WORD_BYTES).split())))
        items = list(counts.items())
        for at in range(0, len(items), 50_000):
            part = items[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k, _ in part], pa.string()), pa.array([k[1] for k, _ in part], pa.int32()), pa.array([k[2] for k, _ in part], pa.int32()), pa.array([n for _, n in part], pa.int64())],
                names=["term", "fold", "y", "n"],
            )

    counted = texts.mapInArrow(returning(count_terms), "term string, fold int, y int, n long").groupBy("term").agg(
        *[F.sum(F.when((F.col("fold") == f) & (F.col("y") == y), F.col("n")).otherwise(0)).alias(f"n{f}{y}") for f in range(1, FOLDS) for y in (0, 1)]
    )
    # only terms that pass in some lexicon come to the driver: the sample's size bounds them, whatever the size of the corpus
    passes = F.lit(False)
    for without in range(FOLDS):
        folds = [f for f in range(1, FOLDS) if f != without]
        n = [sum(sizes.get((f, y), 0) for f in folds) for y in (0, 1)]
        docs_with = [sum(F.col(f"n{f}{y}") for f in folds) for y in (0, 1)]
        bound = _bound(docs_with[1], docs_with[0], n[1], n[0])
        passes = passes | ((docs_with[1] >= MIN_TOXIC_DOCS) & (bound >= MIN_BOUND - 1e-6))
    counts = counted.where(passes).collect()

    def lexicon(without: int) -> dict[str, float]:
        folds = [f for f in range(1, FOLDS) if f != without]
        n = [sum(sizes.get((f, y), 0) for f in folds) for y in (0, 1)]
        return _lexicon([(r.term, sum(r[f"n{f}1"] for f in folds), sum(r[f"n{f}0"] for f in folds)) for r in counts], n[1], n[0])

    shared = docs.sparkSession.sparkContext.broadcast({f: lexicon(f) for f in range(FOLDS)})

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurizers = {f: Featurizer(x) for f, x in shared.value.items()}
        for batch in batches:
            rows = [featurizers[f](t.as_py()) for f, t in zip(batch.column(0).to_pylist(), batch.column(2).cast(pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["fold", "y", "x"])

    table = texts.mapInArrow(returning(features), "fold int, y int, x array<double>").toPandas()
    x, y, fold = np.array(table["x"].tolist(), float), table["y"].to_numpy(float), table["fold"].to_numpy()
    order = np.lexsort((*x.T, y, fold))  # the same model whatever the order in which tasks end
    x, y, fold = x[order], y[order], fold[order]
    apart = np.zeros(len(y))
    for f in np.unique(fold):
        rest = fold != f
        apart[~rest] = fit_trees(x[rest], y[rest]).margin(x[~rest]) if rest.any() else 0.0
    return Model(lexicon(0), fit_trees(x, y), fit_isotonic(apart, y))


def with_toxicity(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with their score, all other columns untouched."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = shared.value.scorer()
        for texts in batches:
            yield pd.Series(scorer([t.encode() for t in texts]))
        give_back()

    return docs.withColumn(score_col, score(text_of(text_col)))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, id_col, text_col, **options)
    thin = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held_out = F.coalesce(fold_of("doc_id") == 0, F.lit(False)).alias("held_out")
    return with_toxicity(thin, model).select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
