import random

import numpy as np

from netsets.llm import url_filter
from netsets.llm.url_filter import Cascade, Level, judge_urls

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    cut = min([i for c in "/?#" if (i := rest.find(c)) >= 0], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([i for c in "?#" if (i := path.find(c)) >= 0], default=len(path))]


def brute(url, listed):
    host, path = parts(url)
    fits = [r for r in RULES if (host == (d := r[0].split("/")[0]) or host.endswith("." + d)) and path.startswith(r[0][len(d) :])]
    rule = max(fits, key=lambda r: len(r[0]), default=None)
    inside = any(host == d or host.endswith("." + d) for d in listed)
    return host, path, rule and rule[0], inside, rule[1] if rule else "block" if inside else "allow"


def run(spark, urls, listed):
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, key int").repartition(3)
    keys = spark.createDataFrame([(k,) for k in listed], "key string")
    got = {r.page_id: tuple(r)[1:] for r in judge_urls(pages, keys, RULES).collect()}
    assert got == {i: brute(u, [k for k in listed if k is not None]) for i, u in enumerate(urls)}


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "://", "http://", "HTTP://A.Example.NET/en/x?y#z", "x://net", "x://net/", "x://net?/en/", "a://b://c/d", "http://É.org/fr/", "http://org/fr", "http://bad.com#/de/", "http://example.com/de/\nq", "http://x..bad.com/"]
    urls += urls[:7] + ["http://h.com/" + "p" * 100_000]
    run(spark, urls, ["bad.com", None, "bad.com", "missing.org"])
    run(spark, urls, [])
    run(spark, [], ["bad.com"])


def test_many_hosts_and_shards(spark, monkeypatch):
    rng = random.Random(1)
    hosts = [".".join(rng.choices("abcdefgh", k=rng.randrange(2, 6))) + rng.choice([".com", ".org", ".net"]) for _ in range(1500)]
    urls = [f"https://{h}/{rng.choice(['en', 'de', 'fr'])}/{i}" for i, h in enumerate(hosts)]
    listed = rng.sample(hosts, 200) + ["a.com", "nowhere.net"]
    run(spark, urls, listed)
    monkeypatch.setattr(url_filter, "MAX_FILTER_BYTES", 64)
    run(spark, urls[:600], listed)


def test_cascade_parity():
    full = Level(64, 1, np.array([2**64 - 1], np.uint64))
    none = Level(64, 1, np.array([0], np.uint64))
    h = np.arange(5)
    assert Cascade([]).listed(h, h).sum() == 0
    assert Cascade([full]).listed(h, h).all() and not Cascade([none]).listed(h, h).any()
    assert Cascade([full, none]).listed(h, h).all() and not Cascade([full, full]).listed(h, h).any()
