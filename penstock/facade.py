"""One entry point over a session: the canonical tables as views, and every operator by module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .operators import duplicates, enrich, learning, lists, merges, places, predict, privacy, products, ranking, recollapse, reconcile, records, refine, resolution, search, spend, stars, stats, store
from .plans import search_plan
from .sources import adapter, bank, files
from .streaming import streams


class Engine:
    """engine.facts, engine.items and engine.stars are lazy; engine.sql sees them as views."""

    enrich, lists, predict, privacy, records, resolution, search, spend, stars_ops, stats, store = enrich, lists, predict, privacy, records, resolution, search, spend, stars, stats, store
    duplicates, learning, merges, places, products, ranking, recollapse, reconcile, refine = duplicates, learning, merges, places, products, ranking, recollapse, reconcile, refine
    plans, bank, files, streams = search_plan, bank, files, streams

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.facts: DataFrame = adapter.facts(spark, sf_dir)
        self.items: DataFrame = adapter.fact_items(spark, sf_dir)
        self.stars: DataFrame = stars.rebuild_item_stars(self.items, self.facts)
        spark.dataSource.register(bank.OfxDataSource)

    def register_views(self) -> Engine:
        self.facts.createOrReplaceTempView("facts")
        self.items.createOrReplaceTempView("fact_items")
        self.stars.createOrReplaceTempView("item_stars")
        return self

    def sql(self, text: str, **args) -> DataFrame:
        """Bound parameters, never text that is pasted together."""
        return self.spark.sql(text, args=args) if args else self.spark.sql(text)
