import hashlib
import random
import re

from netsets.llm import decontaminate
from netsets.llm.decontaminate import benchmark_hits

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            n = min(window, len(v))
            for i in range(len(v) - n + 1 if n else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == v[i : i + n]:
                        hit.update(range(j, j + n))
                        if item_id is not None:
                            found.add(item_id)
        named = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), named, bool(hit)))
    return sorted(out, key=str)


def cases(seed):
    rng = random.Random(seed)
    pool = "aa b cc d É é 1 zz".split()
    items = [(i, " ".join(rng.choices(pool, k=rng.choice([1, 2, 3, 9, 10, 11, 25])))) for i in range(1, 14)]
    items += [(13, "one two three"), (None, "q w e r t y u i o p a"), (99, None), (100, " .,- "), (101, "lonely")]
    docs = []
    for i in range(60):
        text = [rng.choice(pool + ["x", "y"] * 8) for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            v = words(rng.choice(items)[1])
            text[rng.randrange(len(text) + 1) : 0] = [x.upper() if x.isascii() else x for x in v[rng.randrange(3) :]]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(text)))
    return docs + [(70, None), (71, ""), (None, "lonely"), (72, "q w e r t y u i o p"), (72, "q w e r t y u i o p"), (73, "x " * 100_000 + "lonely")], items


def run(spark, docs, items):
    d = spark.createDataFrame([(*r, 1, "z") for r in docs], "doc_id long, text string, n_hit int, items string")
    b = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, doc_id int")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted((tuple(r) for r in benchmark_hits(d, b).select(cols).collect()), key=str)


def test_against_brute_force(spark):
    for seed in (1, 2):
        docs, items = cases(seed)
        assert run(spark, docs, items) == brute(docs, items)


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK_BYTES", 120)
    docs, items = cases(3)
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = cases(4)
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, [], items) == []


def test_flag_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK_BYTES", 120)
    docs, items = cases(5)
    d = spark.createDataFrame([(*r, 1, "z") for r in docs], "doc_id long, text string, n_hit int, items string")
    b = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, doc_id int")
    flagged = decontaminate.with_contaminated(d, b)
    assert flagged.columns == [*d.columns, "contaminated"]
    assert sorted(((r.doc_id, r.contaminated) for r in flagged.collect()), key=str) == sorted(((r[0], r[5]) for r in brute(docs, items)), key=str)


def test_repeated_windows_and_a_wide_window():
    """A long item of one word has one window, however often it occurs in it; windows of over 255 words work too."""
    one = decontaminate.Compiled([(1, b"a " * 50_000), (2, b"a " * 12)], 10)
    assert [len(t.key) for t in one.tables] == [2]
    assert [(s, sorted(i for _, i in one.tables[0].find([b"a"] * 11) if _ == s)) for s in (0, 1)] == [(0, [0, 1]), (1, [0, 1])]
    item = " ".join(f"w{i % 7}x{i}" for i in range(600))
    wide = decontaminate.Compiled([(1, item.encode())], 300)
    assert [s for s, _ in wide.tables[0].find(("z " * 5 + item).split() and [w.encode() for w in ("z " * 5 + item).split()])] == list(range(5, 306))


def test_memory_of_a_full_block():
    """A block of 16 MB of items, all words drawn from many: under 300 MB while it is compiled and held."""
    import subprocess
    import sys

    code = (
        "import random, resource\n"
        "from netsets.llm.decontaminate import Compiled\n"
        "rng = random.Random(1)\n"
        "pool = [''.join(rng.choices('abcdefghijklmnop', k=rng.randrange(3, 9))) for _ in range(200_000)]\n"
        "items = [(i, ' '.join(rng.choices(pool, k=180)).encode()) for i in range(14_200)]\n"
        "assert sum(len(t) for _, t in items) > 16_000_000\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "c = Compiled(items, 10)\n"
        "print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024, len(c.tables[0].key))\n"
    )
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=300).stdout.split()
    assert float(said[0]) < 300 and int(said[1]) > 2_000_000, said
