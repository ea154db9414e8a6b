"""Ranked retrieval: BM25 over postings, where a query's tokens stand for all words that begin with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut_lineage

# The two constants of the ranking and the least weight of a word.
K1, B, LEAST_WEIGHT = 1.2, 0.75, 1e-6
#: Rows of a table that is broadcast, at most; and texts of a token that meet its queries in one task.
SMALL, MANY = 500_000, 200_000


def tokens(text: Column) -> Column:
    """Folded words of letters and digits, in order."""
    fold = F.translate(F.lower(text), "áàâäãåéèêëíìîïóòôöõúùûüñç", "aaaaaaeeeeiiiiooooouuuunc")
    return F.filter(F.split(fold, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(texts: DataFrame, key: str, text: str) -> DataFrame:
    """token, key, tf and the length of the key's text, for distinct keys. Null texts have no words."""
    words = texts.select(F.col(key).alias("key"), tokens(F.coalesce(text, F.lit(""))).alias("w")).select("key", F.size("w").alias("length"), F.explode("w").alias("token"))
    return words.groupBy("token", "key", "length").agg(F.count("*").alias("tf"))


def asked(queries: DataFrame, most: int = 5) -> DataFrame:
    """q, k, prefix and n: the first tokens of each query's text, and their number."""
    t = F.slice(tokens(F.coalesce("text", F.lit(""))), 1, most)
    return queries.select("q", F.posexplode(t).alias("k", "prefix"), F.size(t).alias("n"))


def weighted(index: DataFrame, prefixes: DataFrame, n_texts: int, mean_length: float) -> DataFrame:
    """prefix, key, part and df: what each text with words of a prefix gets for it. index: of postings(); prefixes: distinct. Words are cut to the lengths that are asked for, so that prefixes meet by equality."""
    lengths = sorted(r.n for r in prefixes.select(F.length("prefix").alias("n")).distinct().collect())  # token lengths
    if not lengths:
        return index.select(F.col("token").alias("prefix"), "key", F.lit(0.0).alias("part"), F.lit(0).cast("bigint").alias("df")).where("false")
    cut = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("token"))
    heads = index.select("key", "length", "tf", F.explode(F.transform(cut, lambda n: F.substring(F.col("token"), F.lit(1), n))).alias("prefix"))
    few = prefixes.count() <= SMALL
    heads = heads.join(F.broadcast(prefixes) if few else prefixes, "prefix", "left_semi")
    met = cut_lineage(heads.groupBy("prefix", "key", "length").agg(F.sum("tf").alias("tf")))
    df = met.groupBy("prefix").agg(F.count("*").alias("df"))
    weight = F.greatest(F.log((F.lit(n_texts) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_WEIGHT))
    part = weight * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean_length))
    return met.join(F.broadcast(df) if few else df, "prefix").select("prefix", "key", part.alias("part"), "df")


def _top(rows: DataFrame, limit: int) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "key"))
    return rows.withColumn("rank", r).where(F.col("rank") <= limit)


def ranked(texts: DataFrame, queries: DataFrame, key: str = "name", text: str | None = None, and_limit: int = 100, or_limit: int = 200) -> DataFrame:
    """queries: q, text. q, key, hits, score and rank: the texts with all of a query's first five tokens as prefixes, best first, and_limit of them at most; where there are none, those with any, or_limit at most (the operator's own limits). Scores are rounded to six places, and ties go by key.

    A frequent token's texts and its queries are dealt into parts, so that they don't meet in one task."""
    texts = texts.select(F.col(key).alias("_key"), F.col(text or key).alias("_text")).dropDuplicates(["_key"])
    index = cut_lineage(postings(texts, "_key", "_text"))
    n_texts = texts.count()
    mean = index.select("key", "length").distinct().agg(F.sum("length")).first()[0] or 0
    q = cut_lineage(asked(queries))
    parts = cut_lineage(weighted(index, q.select("prefix").distinct(), n_texts, max(mean / max(n_texts, 1), 1e-9)))
    pieces = lambda c: F.ceil(F.col(c) / MANY).cast("int")
    often = parts.groupBy("prefix").agg(F.max("df").alias("df"))
    dealt = q.join(often, "prefix").withColumn("piece", F.explode(F.sequence(F.lit(0), pieces("df") - 1))).drop("df")
    hit = dealt.join(parts.withColumn("piece", F.pmod(F.xxhash64("key"), pieces("df"))), ["prefix", "piece"])
    scored = cut_lineage(hit.groupBy("q", "key", "n").agg(F.round(F.sum("part"), 6).alias("score"), F.count("*").alias("hits")))
    whole = cut_lineage(_top(scored.where("hits = n"), and_limit))
    rest = _top(scored.join(whole.select("q").distinct(), "q", "left_anti"), or_limit)
    return whole.unionByName(rest).select("q", F.col("key").alias(key), "hits", "score", "rank")
