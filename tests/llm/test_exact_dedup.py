import hashlib

from netsets.llm.exact_dedup import exact_duplicates

ROWS = [(i, t) for i, t in enumerate(["a", "b", "a", None, "", "x" * 200_000, "a", "x" * 200_000, "é z"] + ["hot"] * 400)]


def expected(rows, best):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = set()
    for i, t in rows:
        own = [x for x in groups[t or ""] if x is not None]
        keep = best(own) if own else None
        out.add((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, t int, k int").repartition(5)


def test_against_brute_force(spark):
    for keep, best in (("largest", max), ("smallest", min)):
        got = [tuple(r) for r in exact_duplicates(frame(spark, ROWS), keep=keep).collect()]
        assert len(got) == len(ROWS) and set(got) == expected(ROWS, best)


def test_repeated_rows_nulls_and_empty(spark):
    rows = [(None, "n"), (None, "n"), (1, "r"), (1, "r"), (1, "r"), (None, "m"), (3, "m")]
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_duplicates(frame(spark, rows), keep="largest").collect()]
    assert sorted(got, key=str) == sorted(
        [(None, None, 2, True), (None, None, 2, False), (1, 1, 3, True), (1, 1, 3, False), (1, 1, 3, False), (None, 3, 2, False), (3, 3, 2, True)], key=str
    )
    assert exact_duplicates(frame(spark, [])).collect() == []


def test_prefix_shared_by_all(spark):
    rows = [(i, "same leading bytes of every text here " + str(i % 7)) for i in range(300)]
    got = {tuple(r) for r in exact_duplicates(frame(spark, rows), keep="largest").collect()}
    assert got == expected(rows, max)
