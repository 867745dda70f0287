"""Triangles by blocks of edges, against sets of neighbours, and what they send between tasks."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from netsets.operators import blocks as B
from netsets.operators import graph as G


def sent(spark):
    """Bytes that all tasks so far have written for others. The store is brought up to date by a later task, some tenths of a second after."""
    time.sleep(0.5)
    spark.range(1).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def some_edges(seed, spread):
    rng = random.Random(seed)
    ids = {rng.randrange(-spread, spread) for _ in range(40)}
    return [(u, v, rng.random()) for u, v in itertools.combinations(sorted(ids), 2) if rng.random() < 0.25 or u == min(ids)]


def near_of(rows):
    near = {}
    for u, v, *_ in rows:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    return near


def counted(rows):
    near = near_of(rows)
    return {x: (len(near[x]), sum(b in near[a] for a, b in itertools.combinations(near[x], 2))) for x in near}


@pytest.mark.parametrize("spread", [30, 2**62])
@pytest.mark.parametrize("colours", [1, 2, 3, 5])
def test_counts_for_any_number_of_colours(spark, monkeypatch, spread, colours):
    monkeypatch.setattr(B, "colours_for", lambda n: colours)
    rows = some_edges(colours, spread)
    got = G.clustering(spark.createDataFrame(rows, "u bigint, v bigint, w double")).collect()
    assert {r.node: (r.degree, r.triangles) for r in got} == counted(rows) and len(got) == len(counted(rows))


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_no_edges(spark, kind):
    none = spark.createDataFrame([], f"u {kind}, v {kind}, w double")
    assert G.clustering(none).collect() == [] and G.triangles(none).collect() == []
    assert G.clustering(none).columns == ["node", "degree", "triangles", "coefficient"]


def test_clustering_sends_no_lists_with_edges(spark):
    """60 edges a node: the lists of neighbours that go with every edge would be some thirty times the edges."""
    edges = spark.range(60_000).selectExpr("xxhash64(id, 1) % 1000 as a", "xxhash64(id, 2) % 1000 as b").selectExpr("least(a, b) as u", "greatest(a, b) as v")
    edges = edges.where("u < v").distinct().withColumn("w", F.lit(1.0)).localCheckpoint()
    before = sent(spark)
    got = {r.node: (r.degree, r.triangles) for r in G.clustering(edges).collect()}
    assert sent(spark) - before < 1_000_000
    assert got == counted([(r.u, r.v) for r in edges.collect()])


@pytest.mark.parametrize("kind", ["bigint", "string"])
@pytest.mark.parametrize("colours", [1, 2, 4])
def test_triangles_with_their_weights(spark, monkeypatch, kind, colours):
    """Numbers have another order as text, and the weights go with it."""
    monkeypatch.setattr(B, "colours_for", lambda n: colours)
    cast = str if kind == "string" else int
    rows = [(*sorted((cast(u), cast(v))), w) for u, v, w in some_edges(colours, 300)]
    near, weight = near_of(rows), {(u, v): w for u, v, w in rows}
    want = sorted((a, b, c, weight[a, b], weight[a, c], weight[b, c]) for a in near for b in near[a] for c in near[a] & near[b] if a < b < c)
    edges = spark.createDataFrame(rows, f"u {kind}, v {kind}, w double")
    assert sorted(map(tuple, G.triangles(edges).collect())) == want
    text = G.in_order(G.triangles(edges).withColumns({c: F.col(c).cast("string") for c in "abc"}))
    told = {(str(x), str(y)): w for u, v, w in rows for x, y in ((u, v), (v, u))}
    got = text.collect()
    assert len(got) == len(want) and all(r.a < r.b < r.c and (r.wab, r.wac, r.wbc) == (told[r.a, r.b], told[r.a, r.c], told[r.b, r.c]) for r in got)


def test_triangles_are_not_sent_themselves(spark):
    """Some ten triangles an edge: their weights come with the edges."""
    pairs = spark.range(300).selectExpr("id as u", "explode(sequence(id, 299)) as v").where("u < v and pmod(xxhash64(u, v), 3) = 0")
    edges = pairs.selectExpr("u", "v", "pmod(xxhash64(v, u), 1000) / 7 as w").localCheckpoint()
    before = sent(spark)
    got = G.triangles(edges).agg(F.count("*")).first()[0]
    moved = sent(spark) - before
    assert moved < 1_000_000, moved
    assert got == sum(t for _, t in counted([(r.u, r.v) for r in edges.collect()]).values()) // 3
