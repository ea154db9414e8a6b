"""The corpus pipeline: rejects bad documents, rejects unknown languages, removes near copies, mixes sources, packs tokens.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents. SQL can't express the learned stages, so ORACLE_SQL is None and the tests hold run() against its parts.

Defined results, at every stage: null and empty texts have no words, so the first stage rejects them (in later stages, were
they to get there: no language, no shingles and so no copies, drawn like their cell, the end id alone); null ids, sources and
languages are values like any other; repeated rows are judged alike and near_dedup keeps one; ties go by id, then by text; a
very long text is read whole; an empty table stays empty; columns other than those of documents go at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from penstock.llm import langid, mixing, neardup, packing, quality
from penstock.llm.common import documents, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    return quality.keep(spark, docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose language can't be told."""
    model = langid.train(docs)
    verdict = langid.predictor(spark, model)("text")
    return docs.select(*COLUMNS, verdict.alias("_verdict")).where("not _verdict.rejected").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return neardup.distinct_texts(docs, neardup.Rule(5, 80)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics meet their target shares of tokens."""
    return mixing.sample(spark, docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the kept documents, placed in sequences of 1024 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and reread."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
