"""Password guess cost: the cheapest way to cut a value into words, dates, repeats, keyboard walks and brute-force spans.

The dynamic programme runs over the ends of the whole value, of any length. A part that grows with a logarithm (runs, steps, walks,
repeats) keeps only the beginnings that can still be cheapest, so time and memory are linear in the value for all but contrived ones.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterable
from math import log10

# Common passwords and words of passwords, commonest first; a word's rank is its place.
COMMON = (
    "password 123456 12345678 qwerty abc123 monkey letmein dragon iloveyou trustno1 sunshine master welcome shadow ashley football jesus michael ninja "
    "mustang admin administrator root login guest test user default changeme secret token access server database system manager oracle example sample "
    "dummy placeholder none null true false your yourpassword mypassword pass passwd key apikey api hello world love summer winter spring autumn "
    "monday friday january december baseball superman batman starwars computer internet google cheese flower orange banana purple soccer hockey "
    "tigger charlie jordan jennifer thomas robert daniel andrew hunter killer pepper cookie ginger silver golden diamond phoenix thunder tiger eagle "
    "the and for with this that from have not you are was but all one two three four five six seven eight nine ten zero"
).split()
# Rows of a keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
# Characters that stand for letters.
STANDS_FOR = str.maketrans("4@83106$57!", "aabeiogsstl")
PLACE = {c: (r, i + (0, 0.5, 0.75, 1.25)[r]) for r, row in enumerate(ROWS) for i, c in enumerate(row)}

DATE = re.compile(r"(\d{1,4})([-/._]?)(\d{1,2})\2(\d{1,4})")
YEAR = re.compile(r"(?:19|20)\d\d")
DATE_LENGTHS = range(4, 11)
#: Least length of a word, run, step or walk that is a part of its own.
LEAST = 3
#: Lengths of the strings whose nearest earlier place proposes the length of a repeated block.
ECHOES = (2, 4, 8, 16, 32)
#: Cost of starting one more part, of a brute-force span of several characters, of the first key of a walk, and of changing its row.
PART, SPAN, FIRST_KEY, TURN = log10(2), 0.3, log10(47), 0.35
#: Most words of all lists: they are sent to every task.
MOST_WORDS = 200_000


def vocabulary_words(path: str) -> list[str]:
    """Words of a tokenizer's vocabulary, commonest first: tokens that end a word (a .json of BPE with word ends) or begin one (a .tiktoken)."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as lines:
            tokens = [base64.b64decode(line.split()[0]).decode("utf-8", "ignore") for line in lines if line.strip()]
        words = [t[1:] for t in tokens if t.startswith(" ")]
    else:
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        words = [t[: -len("</w>")] for t in sorted(vocab, key=vocab.get) if t.endswith("</w>")]
    return list(dict.fromkeys(w.lower() for w in words if len(w) >= LEAST and w.isalpha()))


def ranked(*lists: Iterable[str]) -> dict[str, int]:
    """word -> its best place in any list, from 1; the stated words are always the first list."""
    rank: dict[str, int] = {}
    for words in (COMMON, *lists):
        for place, word in enumerate(dict.fromkeys(words), 1):
            rank[word] = min(place, rank.get(word, place))
    if len(rank) > MOST_WORDS:
        raise ValueError(f"{len(rank)} words are more than the {MOST_WORDS} that a task may hold")
    return rank


def _alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100


def _beside(a: str, b: str) -> bool:
    p, q = PLACE.get(a), PLACE.get(b)
    return bool(p and q and a != b and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1.0)


def _year_near(y: int) -> float:
    return log10(max(abs(y - 2020), 20))


def date_cost(part: str) -> float | None:
    if YEAR.fullmatch(part):
        return _year_near(int(part))
    m = DATE.fullmatch(part)
    if not m:
        return None
    best = None
    first, sep, mid, last = m.groups()
    for y, a, b in ((first, mid, last), (last, first, mid)):
        if len(y) in (2, 4) and len(a) <= 2 and len(b) <= 2:
            d, mth = int(a), int(b)
            if (1 <= d <= 31 and 1 <= mth <= 12) or (1 <= mth <= 31 and 1 <= d <= 12):
                year = int(y) if len(y) == 4 else 1900 + int(y)
                if 1900 <= year <= 2050 or len(y) == 2:
                    cost = log10(365) + _year_near(year) + (log10(4) if sep else 0)
                    best = cost if best is None else min(best, cost)
    return best


class Growing:
    """Least of base + log10(end - start) over the beginnings offered so far.

    The advantage of a later beginning over an earlier one only shrinks as the end moves on: one that is dearer when it is offered, or
    becomes so, never leads again and is dropped.
    """

    __slots__ = ("held",)

    def __init__(self):
        self.held: list[tuple[int, float]] = []

    def offer(self, start: int, base: float) -> None:
        # one that begins earlier at a higher base is dearer at every end
        self.held = [(s, b) for s, b in self.held if b <= base]
        self.held.append((start, base))

    def least(self, end: int) -> float:
        best, kept = float("inf"), []
        for start, base in self.held:
            cost = base + log10(end - start)
            if cost < best:
                best = cost
                kept.append((start, base))
        self.held = kept
        return best


class Guesser:
    """Costs of values by one ranked word list; call it with a value."""

    #: Values whose cost is remembered, and the longest of them: bounds of memory.
    REMEMBERED, REMEMBERED_LENGTH = 20_000, 100

    def __init__(self, rank: dict[str, int] | None = None):
        self.rank = ranked() if rank is None else rank
        self.longest = max(map(len, self.rank), default=0)
        self.known: dict[str, float] = {}

    def __call__(self, value: str) -> float:
        """log10 of the guesses that the cheapest segmentation needs: a part costs its own guesses and a factor of two for its place."""
        held = self.known.get(value)
        if held is None:
            held = self._cost(value)
            if len(value) <= self.REMEMBERED_LENGTH:
                if len(self.known) >= self.REMEMBERED:
                    self.known.clear()
                self.known[value] = held
        return held

    def word_cost(self, part: str, low: str, plain: str) -> float | None:
        """part, its small letters, and these with stand-ins replaced: its rank as it stands, else unmasked, else backwards; and its case."""
        rank, extra = self.rank.get(low), 0.0
        if rank is None and plain != low:
            rank, extra = self.rank.get(plain), sum(a != b for a, b in zip(low, plain, strict=True)) * log10(2)
        if rank is None:
            rank, extra = self.rank.get(low[::-1]), log10(2)
        if rank is None:
            return None
        upper = sum(c.isupper() for c in part)
        case = 0.0 if not upper else log10(2) if upper in (1, len(part)) else upper * log10(len(part))
        return log10(rank + 1) + extra + case

    def _cost(self, value: str) -> float:
        n = len(value)
        if not n:
            return 0.0
        low = "".join(x if len(x := c.lower()) == 1 else c for c in value)
        plain = low.translate(STANDS_FOR)
        each = [log10(_alphabet(c)) for c in value]
        best = [0.0] + [float("inf")] * n
        brute, least_brute = [0.0], float("inf")  # the least of best[start] - brute[start], for spans of two and more
        run, step, walk, turns = Growing(), Growing(), Growing(), [0.0]
        run_from = step_from = walk_from = 0
        echoes: dict[int, tuple[int, Growing]] = {}  # period -> where the text began to repeat, and the parts that go on repeating
        seen: dict[str, int] = {}
        for end in range(1, n + 1):
            last = end - 1
            brute.append(brute[-1] + each[last])
            cost = best[last] + each[last]
            if end > 1:
                least_brute = min(least_brute, best[end - 2] - brute[end - 2])
                cost = min(cost, least_brute + brute[end] + SPAN)
                turned = low[last] in PLACE and low[last - 1] in PLACE and PLACE[low[last]][0] != PLACE[low[last - 1]][0]
                turns.append(turns[-1] + TURN * turned)
                if value[last] != value[last - 1]:
                    run, run_from = Growing(), last
                if not _beside(low[last - 1], low[last]):
                    walk, walk_from = Growing(), last
                delta = ord(value[last]) - ord(value[last - 1])
                if abs(delta) != 1:
                    step, step_from = Growing(), last
                elif end > 2 and delta != ord(value[last - 1]) - ord(value[last - 2]):
                    step, step_from = Growing(), last - 1
            else:
                turns.append(0.0)
            start = end - LEAST
            if start >= 0:
                if start >= run_from:
                    run.offer(start, best[start] + each[start])
                if start >= walk_from:
                    walk.offer(start, best[start] + FIRST_KEY - turns[start + 1])
                if start >= step_from:
                    step.offer(start, best[start] + each[start])
                cost = min(cost, run.least(end), step.least(end), walk.least(end) + turns[end])
            for begin in range(max(0, end - self.longest), end - LEAST + 1):
                word = self.word_cost(value[begin:end], low[begin:end], plain[begin:end])
                if word is not None:
                    cost = min(cost, best[begin] + word)
            if value[last].isdigit():
                for length in DATE_LENGTHS:
                    if length <= end and value[end - length].isdigit():
                        date = date_cost(value[end - length : end])
                        if date is not None:
                            cost = min(cost, best[end - length] + date)
            for period in [p for p in echoes if value[last] != value[last - p]]:
                del echoes[period]
            for length in ECHOES:
                if length <= end:
                    echo = value[end - length : end]
                    before = seen.get(echo)
                    seen[echo] = end
                    if before is not None and (period := end - before) > 1 and period not in echoes:
                        since = end - length
                        while since - period > 0 and value[since - 1] == value[since - 1 - period]:
                            since -= 1
                        part = Growing()
                        for begin in range(max(since, period), end - period):
                            part.offer(begin, best[begin])
                        echoes[period] = max(since, period), part
            for period, (since, part) in echoes.items():
                if end - period >= since:
                    part.offer(end - period, best[end - period])
                    cost = min(cost, part.least(end))
            best[end] = cost + PART
        return best[n]


_stated: Guesser | None = None


def guess_cost(value: str) -> float:
    """The cost by the stated words alone."""
    global _stated
    _stated = _stated or Guesser()
    return _stated(value)
