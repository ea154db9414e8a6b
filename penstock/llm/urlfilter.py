"""URL rules by a Bloom filter cascade, with DataFrame functions only.

A rule is a host and a path prefix written as one key (`example.org/es/`); it fits its host and all subdomains if the url's
path starts with its path, and the longest fitting key wins (between keys of one length the one with the longer host). A
url's candidate keys are its host's suffixes with its path's prefixes, in the shapes (labels, path length) that the list has.

Level 0 of the cascade is a Bloom filter of the listed keys. Over the complete universe of candidate keys in the corpus its
false positives are known, and level 1 is a filter of them; level 2 holds the listed keys that level 1 lets through, and so
on in turns, until nothing gets through. A key is judged by the first level that refuses it, which is exact for every key of
the universe and of the list. No join takes part: not in the building (false positives are told from listed keys by grouping
their union) and not in the judging (filters are constants of the plan). A second cascade tells blocked from allowed keys.

Defined results: a null url, or one without "://", has empty host and path and is judged `otherwise`; hosts are lower-cased
A-Z only and keep their port; a url is judged alone, so ties, repeated rows and other columns play no part; very long urls
are read whole; without rules everything is judged `otherwise`; an empty table stays empty. A key listed as both allow and
block is blocked; null rules are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Bits a key and probes a key, of level 0 and of the levels that follow.
FIRST, LATER = (10, 5), (4, 2)
#: Listed keys of one cascade: at most 2 MB of level 0. A longer list is judged in several passes, each with its own cascade.
MOST_KEYS = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the query, with what they do.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def _slots(key: Column, level: int, log_bits: int, probes: int) -> list[Column]:
    """The bits of a key in the filter of a level."""
    h = F.xxhash64(F.lit(level), key)
    step = F.call_function("shiftrightunsigned", h, F.lit(32)).bitwiseOR(F.lit(1).cast("long"))
    return [(h + step * F.lit(i)).bitwiseAND(F.lit((1 << log_bits) - 1).cast("long")) for i in range(probes)]


@dataclass(frozen=True)
class Filter:
    level: int
    log_bits: int
    probes: int
    words: str  # its 64-bit words, blank-separated

    def has(self, key: Column) -> Column:
        words = F.split(F.lit(self.words), " ").cast("array<bigint>")  # folded to a constant
        out = F.lit(True)
        for s in _slots(key, self.level, self.log_bits, self.probes):
            word = F.get(words, F.shiftright(s, 6).cast("int"))
            out = out & (F.call_function("shiftrightunsigned", word, s.bitwiseAND(F.lit(63).cast("long")).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
        return out


def bloom(keys: DataFrame, level: int) -> Filter | None:
    """The filter of a table of distinct keys; None if there are none. Bits are put together by aggregation; one row a word comes to the driver."""
    n = keys.count()
    if not n:
        return None
    bits, probes = FIRST if level == 0 else LATER
    log_bits = max(6, (bits * n - 1).bit_length())
    slots = keys.select(F.explode(F.array(*_slots(F.col("key"), level, log_bits, probes))).alias("s"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("s").bitwiseAND(F.lit(63).cast("long")).cast("int"))
    rows = slots.groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(one).alias("b")).collect()
    words = dict(rows)
    return Filter(level, log_bits, probes, " ".join(str(words.get(w, 0)) for w in range(1 << (log_bits - 6))))


@dataclass(frozen=True)
class Cascade:
    filters: tuple[Filter, ...]

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed: decided by the first level that refuses it."""
        out = F.lit(len(self.filters) % 2 == 1)
        for i in reversed(range(len(self.filters))):
            out = F.when(~self.filters[i].has(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def cascade(listed: DataFrame, universe: DataFrame, most_levels: int = 64) -> Cascade:
    """listed: distinct `key`; universe: `key`, repeats allowed, read once. Keys that are in neither may be judged wrongly."""
    first = bloom(listed, 0)
    if first is None:
        return Cascade(())
    filters = [first]
    got = universe.where(first.has(F.col("key"))).select("key", F.lit(False).alias("l")).unionByName(listed.select("key", F.lit(True).alias("l")))
    through = written(got.groupBy("key").agg(F.max("l").alias("l")).where("not l").select("key"), "false-positives")
    held = listed
    for level in range(1, most_levels):
        f = bloom(through, level)
        if f is None:
            return Cascade(tuple(filters))
        filters.append(f)
        held, through = through, written(held.where(f.has(F.col("key"))), "let-through")
    raise RuntimeError(f"the cascade did not end in {most_levels} levels")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def candidates(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Structs of size, host size and key: the host's last labels with the path's first characters, in every shape that fits."""
    labels = F.split(host, "\\.")
    all_shapes = F.from_json(F.lit(str([{"a": a, "b": b} for a, b in shapes]).replace("'", '"')), "array<struct<a:int,b:int>>")
    fit = F.filter(all_shapes, lambda s: (F.size(labels) >= s["a"]) & (F.length(path) >= s["b"]))
    suffix = lambda s: F.array_join(F.slice(labels, F.size(labels) - s["a"] + 1, s["a"]), ".")
    key = lambda s: F.concat(suffix(s), F.substring(path, F.lit(1), s["b"]))
    return F.transform(fit, lambda s: F.struct((F.length(suffix(s)) + s["b"]).alias("size"), F.length(suffix(s)).alias("host"), key(s).alias("key")))


def _clean(rules: DataFrame) -> DataFrame:
    """Distinct keys with lower-case hosts, whether they block, and their shape."""
    host = F.translate(F.regexp_extract("key", "^[^/]*", 0), UPPER, LOWER)
    path = F.substring(F.col("key"), F.length(host) + 1, F.length("key"))
    x = rules.where("key is not null").select(F.concat(host, path).alias("key"), F.size(F.split(host, "\\.")).alias("a"), F.length(path).alias("b"), (F.col("verdict") == "block").alias("block"))
    return x.groupBy("key", "a", "b").agg(F.max("block").alias("block"))


def judged(pages: DataFrame, rules: DataFrame, url_col: str = "url", otherwise: str = "allow", most_keys: int = MOST_KEYS) -> DataFrame:
    """pages with _host, _path, _rule (null: none fits) and _verdict. rules: key, verdict (allow or block)."""
    rules = written(_clean(rules), "rules")
    portions = max(1, -(-rules.count() // most_keys))
    host, path = host_and_path(F.col(url_col))
    out = pages.withColumns({"_host": host, "_path": path, "_best": F.lit(None).cast("struct<size:int,host:int,key:string,block:boolean>")})
    for portion in range(portions):
        own = rules.where(F.pmod(F.xxhash64("key"), F.lit(portions)) == portion)
        shapes = sorted((r.a, r.b) for r in own.select("a", "b").distinct().collect())  # label counts times path lengths of the list
        found = candidates(F.col("_host"), F.col("_path"), shapes)
        keys = pages.select(host.alias("_host"), path.alias("_path")).select(F.explode(found).alias("c")).select("c.key")
        listed, block = cascade(own.select("key"), keys), cascade(own.where("block").select("key"), own.select("key"))
        hit = F.array_max(F.filter(found, lambda c: listed.contains(c["key"])))
        out = out.withColumn("_hit", hit).withColumn("_hit", F.when(F.col("_hit").isNotNull(), F.struct("_hit.size", "_hit.host", "_hit.key", block.contains(F.col("_hit.key")).alias("block"))))
        out = out.withColumn("_best", F.greatest("_best", "_hit")).drop("_hit")  # greatest skips nulls
        if portions > 1:
            out = written(out, "judged")
    verdict = F.when(F.col("_best.block"), "block").when(F.col("_best").isNotNull(), "allow").otherwise(otherwise)
    return out.select(*[F.col(f"`{c}`") for c in pages.columns], "_host", "_path", F.col("_best.key").alias("_rule"), verdict.alias("_verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the verdict on every page's url."""
    rules = spark.createDataFrame(list(RULES), "key string, verdict string")
    out = judged(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return out.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))


ORACLE = """
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
l(rule, dom, prefix, verdict) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
f AS (SELECT p.page_id, p.host, p.path, l.rule, l.verdict FROM p LEFT JOIN l ON (p.host = l.dom OR ends_with(p.host, '.' || l.dom)) AND starts_with(p.path, l.prefix)),
n AS (SELECT page_id, host, path, max(length(rule)) AS longest FROM f GROUP BY ALL),
w AS (SELECT DISTINCT rule, verdict, page_id, host, path FROM f)
SELECT p.page_id, p.host, p.path, w.rule, coalesce(w.verdict, 'allow') AS verdict
FROM p LEFT JOIN n ON p.page_id IS NOT DISTINCT FROM n.page_id AND p.host = n.host AND p.path = n.path
LEFT JOIN w ON w.page_id IS NOT DISTINCT FROM n.page_id AND w.host = n.host AND w.path = n.path AND length(w.rule) = n.longest
"""
