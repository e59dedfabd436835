"""The filter cascade against plain string tests."""

import random

import pytest
from pyspark.sql import functions as F

from floorflow.llm import urls

SCHEMA = "page_id long, url string, host string, rule string, verdict string"


def _parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), path


def _brute(url, rules, otherwise="allow"):
    host, path = _parts(url)
    fits = [
        (len(h + (p or "")), len(h), h + (p or ""), v)
        for h, p, v in rules
        if h and v in ("allow", "block") and (host == h or host.endswith("." + h)) and path.startswith(p or "")
    ]
    best = max(fits, default=(0, 0, None, otherwise))
    return host, path, best[2], best[3]


def _check(spark, rows, rules):
    got = urls.judge(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    found = sorted((tuple(r) for r in got.collect()), key=repr)
    assert found == sorted(((r[0], *_brute(r[1], rules)) for r in rows), key=repr)


ODD = [
    None, "", "no scheme/net/", "http://", "http://net", "http://net/", "http://NET/x", "http://a.example.net/en/", "http://example.net/en",
    "http://example.net/EN/1", "http://xexample.net/en/1", "http://example.com/de/#x", "http://example.com?/de/", "http://b.org/fr/1?x=://y.net/",
    "x://y://example.net/en/", "http://fr.org/fr/", "http://a..net/", "http://.net/", "http://ÄÖ.NET/ü/", "http://example.net:80/en/",
    "http://a.net/" + "x" * 100_000, "http://a.net/en\n/?q", "ftp://a.net/\x00",
]


def test_the_rules_of_the_query(spark):
    rows = [(k, u, "clash", "clash", None) for k, u in enumerate(ODD)] + [(3, ODD[6], None, None, None)] * 2 + [(None, ODD[7], None, None, None)]
    _check(spark, rows, list(urls.RULES))


def test_thousands_of_listed_keys_over_several_levels(spark):
    rng = random.Random(5)
    hosts = [".".join(rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(n)) + rng.choice([".net", ".org"]) for n in (1, 2, 3) for _ in range(400)]
    rows = [(k, f"http://{rng.choice(hosts)}/{rng.choice('abc')}{rng.randrange(40)}/{k}", None, None, None) for k in range(6000)]
    keys = {(_parts(u)[0].split(".", rng.randrange(2))[-1], _parts(u)[1][: rng.choice([0, 3, 4])]) for _, u, *_ in rng.sample(rows, 1500)}
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in sorted(keys)]
    _check(spark, rows, rules)


def test_a_cascade_knows_each_key_of_its_universe(spark):
    universe = spark.range(60_000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    listed = universe.where("xxhash64(key) % 7 = 0")
    cascade = urls.Cascade(listed, universe)
    assert len(cascade.levels) >= 3  # false positives there were
    held = universe.where(cascade.holds(F.col("key")))
    assert held.count() == listed.count() and held.exceptAll(listed).count() == 0


def test_lists_too_long_to_travel_are_joined(spark, monkeypatch):
    rows = [(k, u, None, None, None) for k, u in enumerate(ODD)]
    monkeypatch.setattr(urls, "MOST_BYTES", 1)
    _check(spark, rows, list(urls.RULES))
    monkeypatch.undo()
    shapes = [("n" * k + ".net", "/" * (k % 3), "block") for k in range(1, 9)] + [("net", "/" + "x" * k, "allow") for k in range(30)]
    _check(spark, rows, shapes + [("net", "/", "allow"), ("net", "/", "block"), (None, "/", "block"), ("org", None, "block"), ("com", "/", None)])


@pytest.mark.parametrize("rules", [[], [("net", "/", "maybe")]])
def test_empty_tables(spark, rules):
    _check(spark, [], list(urls.RULES))
    _check(spark, [(1, ODD[5], None, None, None)], rules)
