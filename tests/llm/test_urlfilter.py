"""URL rules against a plain search, and the cascade against its list."""

import random

import pytest
from oracle import connect, difference
from pyspark.sql import functions as F

from penstock.llm import urlfilter

SF = "/root/testdata/sf0.001"
URLS = [None, "", "no scheme.org/x", "http://", "http://ORG", "http://org/", "https://Example.ORG/es/1", "ftp://a.example.org/en/13", "http://example.org/en/2", "http://example.org?x=/es/", "http://notexample.org/es/", "http://x.com/fr/?q", "http://x.com/de/#y", "http://com/de", "a://b://org/", "http://org:80/", "http://.org/", "http://ÄB.org/é", "http://example.org/" + "very/long" * 3000, "http://x.com/de/#y"]


def plain(url, rules, otherwise="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for key, verdict in rules:
        h, p = key.partition("/")[0], key[len(key.partition("/")[0]) :]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (0, 0, "", ""), (len(key), len(h), key, verdict))
    return (host, path, best and best[2], best[3] if best else otherwise)


def rows(out):
    return sorted(((r.url, r._host, r._path, r._rule, r._verdict) for r in out.collect()), key=str)


def test_odd_urls(spark):
    pages = spark.createDataFrame([(u, "x", "y") for u in URLS], "url string, _key string, key string")
    rules = spark.createDataFrame([*urlfilter.RULES, (None, "block"), urlfilter.RULES[0]], "key string, verdict string")
    assert rows(urlfilter.judged(pages, rules)) == sorted(((u, *plain(u, urlfilter.RULES)) for u in URLS), key=str)


@pytest.mark.parametrize("most_keys", [urlfilter.MOST_KEYS, 150])
def test_long_lists(spark, most_keys):
    """A list of 400 keys of many shapes over 3,000 urls, in one cascade and in several passes."""
    rng = random.Random(7)
    name = lambda: rng.choice("abc") * rng.randint(1, 2)
    rules = {".".join(name() for _ in range(rng.randint(1, 3))) + rng.choice(["", "/", "/a", "/ab/", "/b"]): rng.choice(["allow", "block"]) for _ in range(400)}
    urls = [f"http://{'.'.join(name() for _ in range(rng.randint(1, 4)))}/{rng.choice(['', 'a', 'ab/c', 'b?x', 'c'])}" for _ in range(3000)]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    out = urlfilter.judged(pages, spark.createDataFrame(list(rules.items()), "key string, verdict string"), "url", "block", most_keys)
    assert rows(out) == sorted(((u, *plain(u, rules.items(), "block")) for u in urls), key=str)


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(60_000).select(F.concat(F.lit("k"), F.col("id")).alias("key"), (F.col("id") % 29 == 0).alias("l"))
    c = urlfilter.cascade(keys.where("l").select("key"), keys.select("key"))
    assert len(c.filters) > 2
    assert keys.where(c.contains(F.col("key")) != F.col("l")).count() == 0


def test_no_rows_and_no_rules(spark):
    rules = spark.createDataFrame([], "key string, verdict string")
    pages = spark.createDataFrame([("http://a.org/",)], "url string")
    assert rows(urlfilter.judged(pages, rules)) == [("http://a.org/", "a.org", "/", None, "allow")]
    assert rows(urlfilter.judged(pages.limit(0), spark.createDataFrame(list(urlfilter.RULES), "key string, verdict string"))) == []


def test_query(spark):
    assert difference(spark, connect(SF), urlfilter.query, urlfilter.ORACLE, SF) is None


def test_no_python_in_the_plan(spark):
    plan = urlfilter.query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan
