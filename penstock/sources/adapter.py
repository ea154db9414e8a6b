"""The canonical tables of the engine (facts, fact_items, ...) over the star-schema parquet files.

The parquet tables are a stand-in for a purchase ledger: an order is a fact, its customer the vendor, its lines the items.
Schemas are fixed by the expressions here; nothing is inferred and every table is a lazy view over a pruned scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: DuckDB's form of the same views, put in front of oracle queries.
SQL_VIEWS = """
facts AS (
  SELECT o_orderkey AS id, o_orderkey AS cloud_id, c_name AS vendor, CAST(o_custkey AS VARCHAR) AS vendor_key, n_name AS country,
    CASE o_orderstatus WHEN 'F' THEN 'purchase' WHEN 'O' THEN 'subscription_payment' ELSE 'refund' END AS fact_type,
    o_totalprice AS total_amount, CAST(o_orderdate AS DATE) AS event_date,
    CASE n_nationkey % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' ELSE 'RUB' END AS currency,
    CASE n_nationkey % 3 WHEN 1 THEN CAST(0.9 AS DOUBLE) END AS eur_rate
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
fact_items AS (
  SELECT l_orderkey AS fact_id, l_linenumber AS line, p_name AS name, p_name AS comparable_name, p_brand AS brand, p_type AS category,
    l_quantity AS quantity, l_extendedprice * (1 - l_discount) AS total_price, l_tax * 100 AS tax_rate, p_partkey AS part_id,
    CASE WHEN p_size <= 12 THEN 'g' WHEN p_size <= 25 THEN 'kg' WHEN p_size <= 37 THEN 'l' ELSE 'pcs' END AS unit, p_size AS unit_quantity,
    CASE p_size % 5 WHEN 0 THEN 'fresh' WHEN 1 THEN 'frozen' WHEN 2 THEN 'dried' WHEN 3 THEN 'canned' END AS state, p_size % 2 = 0 AS organic,
    CASE WHEN p_size % 7 < 5 THEN lpad(CAST(p_partkey AS VARCHAR), 13, '0') END AS barcode
  FROM lineitem JOIN part ON l_partkey = p_partkey),
item_stars AS (
  SELECT i.*, f.vendor, f.vendor_key, f.country, f.fact_type, f.event_date, f.currency, f.eur_rate,
    i.total_price / (i.quantity * i.unit_quantity) AS comparable_unit_price,
    i.total_price / (i.quantity * i.unit_quantity) * coalesce(f.eur_rate, CASE WHEN f.currency = 'EUR' THEN 1.0 END) AS comparable_unit_price_eur,
    i.total_price * coalesce(f.eur_rate, CASE WHEN f.currency = 'EUR' THEN 1.0 END) AS total_price_eur, i.unit AS comparable_unit
  FROM fact_items i JOIN facts f ON i.fact_id = f.id)
"""


def oracle(sql: str) -> str:
    """A query over the canonical views as one statement for DuckDB; {S:x} and {A:x} are sum and mean through decimals."""
    import re

    sql = re.sub(r"\{S:([^}]*)\}", r"CAST(sum(CAST((\1) + 3e-10 AS DECIMAL(24,6))) AS DOUBLE)", sql)
    sql = re.sub(r"\{A:([^}]*)\}", r"CAST(sum(CAST((\1) + 3e-10 AS DECIMAL(24,6))) AS DOUBLE) / count(\1)", sql)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {SQL_VIEWS.strip()}, {body[15:]}"
    return f"WITH {SQL_VIEWS.strip()}" + (f", {body[5:]}" if body.upper().startswith("WITH ") else f" {body}")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (_read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    mod = F.col("n_nationkey") % 3
    # nation has 25 rows by the schema; customers are joined as the optimizer sees fit.
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderkey").alias("cloud_id"),
        F.col("c_name").alias("vendor"),
        F.col("o_custkey").cast("string").alias("vendor_key"),
        F.col("n_name").alias("country"),
        F.when(F.col("o_orderstatus") == "F", "purchase").when(F.col("o_orderstatus") == "O", "subscription_payment").otherwise("refund").alias("fact_type"),
        F.col("o_totalprice").alias("total_amount"),
        F.to_date("o_orderdate").alias("event_date"),
        F.when(mod == 0, "EUR").when(mod == 1, "USD").otherwise("RUB").alias("currency"),
        F.when(mod == 1, F.lit(0.9)).alias("eur_rate"),
    )


def fact_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return _read(spark, sf_dir, "lineitem").join(_read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("fact_id"),
        F.col("l_linenumber").alias("line"),
        F.col("p_name").alias("name"),
        F.col("p_name").alias("comparable_name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("total_price"),
        (F.col("l_tax") * 100).alias("tax_rate"),
        F.col("p_partkey").alias("part_id"),
        F.when(size <= 12, "g").when(size <= 25, "kg").when(size <= 37, "l").otherwise("pcs").alias("unit"),
        size.alias("unit_quantity"),
        F.when(size % 5 == 0, "fresh").when(size % 5 == 1, "frozen").when(size % 5 == 2, "dried").when(size % 5 == 3, "canned").alias("state"),
        (size % 2 == 0).alias("organic"),
        F.when(size % 7 < 5, F.lpad(F.col("p_partkey").cast("string"), 13, "0")).alias("barcode"),
    )


def item_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.stars import rebuild_item_stars

    return rebuild_item_stars(fact_items(spark, sf_dir), facts(spark, sf_dir))
