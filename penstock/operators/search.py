"""Text search, postings, exact vector search and hybrid ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import seq_ratio
from .merges import name_merges  # noqa: F401


def _has(c: str, q: str) -> Column:
    return F.lower(c).contains(q.lower())


def search_facts(facts: DataFrame, items: DataFrame, q: str) -> DataFrame:
    """Facts whose vendor or one of whose items matches: a union of ids, then a semi-join."""
    ids = facts.where(_has("vendor", q)).select("id").union(items.where(_has("name", q)).select("fact_id")).distinct()
    return facts.join(ids, "id", "left_semi")


def sql_search(facts: DataFrame, documents: DataFrame, items: DataFrame, q: str, limit: int = 10) -> DataFrame:
    """Scored matches of three kinds, each limited before they are merged."""

    def best(df: DataFrame, kind: str, score: Column, id_: str, label: str) -> DataFrame:
        s = df.select(F.lit(kind).alias("kind"), F.col(id_).cast("string").alias("id"), F.col(label).cast("string").alias("label"), score.alias("score")).where("score is not null")
        return s.orderBy(F.desc("score"), "id").limit(limit)

    a = best(facts, "fact", F.when(_has("vendor", q), 0.8), "id", "vendor")
    b = best(documents, "document", F.when(_has("source", q), 0.7).when(_has("text", q), 0.5), "doc_id", "source")
    i = items.groupBy("name", "brand", "category").agg(F.min("fact_id").alias("fact_id"))
    c = best(i, "item", F.when(_has("name", q), 0.75).when(_has("brand", q), 0.65).when(_has("category", q), 0.55), "fact_id", "name")
    return a.unionByName(b).unionByName(c).orderBy(F.desc("score"), "kind", "id").limit(limit)


def vector_search(vectors: DataFrame, query: list[float], limit: int = 10, kinds: list | None = None, kind_col: str = "label") -> DataFrame:
    """Exact nearest neighbours by Euclidean distance; similarity 1 / (1 + d)."""
    v = vectors if kinds is None else vectors.where(F.col(kind_col).isin(kinds))
    q = F.array(*[F.lit(float(x)) for x in query])
    d = F.sqrt(F.aggregate(F.zip_with(F.col("embedding").cast("array<double>"), q, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    out = v.select("vec_id", kind_col, F.round(d, 6).alias("distance"))
    return out.withColumn("similarity", F.round(1 / (1 + F.col("distance")), 6)).orderBy("distance", "vec_id").limit(limit)


def hybrid(vector_hits: DataFrame, text_hits: DataFrame, limit: int = 10) -> DataFrame:
    """id and score of both; text counts for nine tenths; the best of an id stays."""
    both = vector_hits.select("id", "score").unionByName(text_hits.select("id", (F.col("score") * 0.9).alias("score")))
    return both.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def upsert_vectors(index: DataFrame, changed: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    gone = changed.select("vec_id") if removed is None else changed.select("vec_id").union(removed.select("vec_id"))
    return index.join(gone.distinct(), "vec_id", "left_anti").unionByName(changed)


def encode_entities(facts: DataFrame, documents: DataFrame, items: DataFrame, embed) -> DataFrame:
    """Three kinds of entity in one schema; embed: a column function of the whole text."""
    f = facts.select(F.concat(F.lit("fact:"), F.col("id").cast("string")).alias("entity"), F.lit("fact").alias("kind"), F.concat_ws(" ", "vendor", F.col("total_amount").cast("string"), "currency", F.col("event_date").cast("string")).alias("text"))
    d = documents.select(F.concat(F.lit("document:"), F.col("doc_id").cast("string")), F.lit("document"), F.concat_ws(" ", "source", "text"))
    i = items.select("name", "brand", "category").distinct().select(F.concat(F.lit("item:"), F.col("name")), F.lit("item"), F.concat_ws(" ", "name", "brand", "category"))
    return f.union(d).union(i).withColumn("embedding", embed(F.col("text")))


def postings(products: DataFrame, key: str = "name") -> DataFrame:
    """token -> key, folded and without accents, for products with a brand or category."""
    fold = F.translate(F.lower(key), "áàâäãåéèêëíìîïóòôöõúùûüñç", "aaaaaaeeeeiiiiooooouuuunc")
    return products.where("brand is not null or category is not null").select(key).distinct().select(key, F.explode(F.array_distinct(F.filter(F.split(fold, r"[^\p{L}\p{N}]+"), lambda t: t != ""))).alias("token"))


def fts_candidates(index: DataFrame, queries: DataFrame, key: str = "name", and_limit: int = 100, or_limit: int = 200) -> DataFrame:
    """queries: q, text. By the first five tokens as prefixes: names with all of them (at most and_limit), else with any (or_limit), most tokens first. The limits are the operator's own top-k."""
    from pyspark.sql import Window

    toks = F.slice(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda t: t != ""), 1, 5)
    q = queries.select("q", F.posexplode(toks).alias("k", "tok"), F.size(toks).alias("n")).withColumn("head", F.substring("tok", 1, 2))
    hit = q.join(index.withColumn("head", F.substring("token", 1, 2)), "head").where(F.col("token").startswith(F.col("tok"))).groupBy("q", key, "n").agg(F.countDistinct("k").alias("hits"))
    full = F.max((F.col("hits") == F.col("n")).cast("int")).over(Window.partitionBy("q"))
    r = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("hits"), key))
    out = hit.withColumn("full", full).where((F.col("full") == 0) | (F.col("hits") == F.col("n"))).withColumn("r", r)
    return out.where(F.col("r") <= F.when(F.col("full") == 1, and_limit).otherwise(or_limit)).select("q", key, "hits")


def resolve_products(queries: DataFrame, catalogue: DataFrame, threshold: float = 0.80) -> DataFrame:
    """queries: q, name, vendor_key. catalogue: name, vendor_key, brand, category, ord. The same name at the same vendor, at any, else the most similar candidate (+0.05 at the same vendor, 1 at most)."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    newest = catalogue.withColumn("norm", norm("name")).groupBy("norm", F.col("vendor_key").alias("cv")).agg(F.max_by(F.struct("brand", "category"), "ord").alias("p"))
    q = queries.withColumn("norm", norm("name"))
    exact = q.join(newest, "norm").groupBy("q").agg(F.min_by("p", F.struct(F.col("vendor_key") != F.col("cv"), "cv")).alias("p"), F.min(F.col("vendor_key") != F.col("cv")).alias("other")).select("q", "p", F.when(F.col("other"), "exact").otherwise("exact_vendor").alias("how"), F.lit(1.0).alias("score"))
    rest = q.join(exact, "q", "left_anti")
    cand = fts_candidates(postings(newest.select(F.col("norm").alias("name"), "p.brand", "p.category")), rest.select("q", F.col("norm").alias("text")))
    # Names are compared once, whatever number of vendors has them.
    alike = cand.select("q", F.col("name").alias("cn")).join(rest, "q").withColumn("ratio", seq_ratio(F.col("norm"), F.col("cn"))).where(F.col("ratio") >= threshold - 0.051)
    pairs = alike.join(newest.withColumnRenamed("norm", "cn"), "cn")
    s = F.least(F.lit(1.0), F.col("ratio") + F.when(F.col("vendor_key") == F.col("cv"), 0.05).otherwise(0.0))
    fuzzy = pairs.withColumn("score", s).where(F.col("score") >= threshold).groupBy("q").agg(F.max_by("p", F.struct("score", "cn", "cv")).alias("p"), F.round(F.max("score"), 4).alias("score"))
    return exact.unionByName(fuzzy.select("q", "p", F.lit("fuzzy").alias("how"), "score")).select("q", "how", "score", "p.brand", "p.category")


def search_context(stars: DataFrame, most: int = 50) -> DataFrame:
    """Registry of facets: the first values of each, sorted (the registry's own limit)."""
    from pyspark.sql import Window

    out = None
    for f in ("category", "currency", "country", "brand", "fact_type"):
        one = stars.select(F.lit(f).alias("facet"), F.col(f).alias("value")).where("value is not null").distinct()
        out = one if out is None else out.unionByName(one)
    return out.withColumn("r", F.row_number().over(Window.partitionBy("facet").orderBy("value"))).where(F.col("r") <= most).drop("r")


def apply_merges(items: DataFrame, mapping: DataFrame) -> DataFrame:
    """items with comparable names rewritten by (comparable_name, unit) -> canonical; a null unit matches the empty one."""
    m = mapping.select(F.col("name").alias("_n"), F.coalesce("unit", F.lit("")).alias("_u"), "canonical")
    j = items.join(m, (F.col("comparable_name") == F.col("_n")) & (F.coalesce("comparable_unit", F.lit("")) == F.col("_u")), "left")
    return j.withColumn("comparable_name", F.coalesce("canonical", "comparable_name")).drop("_n", "_u", "canonical")


def cross_vendor_products(stars: DataFrame, least: int = 2, limit: int = 200) -> DataFrame:
    return stars.where("category is not null").groupBy("comparable_name", "category").agg(F.countDistinct("vendor_key").alias("vendors")).where(F.col("vendors") >= least).orderBy(F.desc("vendors"), "comparable_name", "category").limit(limit)
