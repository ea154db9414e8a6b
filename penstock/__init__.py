"""Spark-native analytics over purchase facts: entity resolution, item-star analytics, search, privacy and streaming ingestion."""
