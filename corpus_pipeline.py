"""The corpus pipeline: five stages over ``documents``, each written and read again.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the
columns of ``docs``, whatever further ones there are and whatever their names; the last returns
packed pieces. Rows are judged by their own text, whether or not they have an id or share it.
Rows with a null text have no toxic words and no language, so stage 2 rejects them. An empty
table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halocline.llm import decontaminate, langid, packing, simhash, toxicity
from halocline.llm.common import materialize, table
from halocline.llm.queries import word_tokenizer

#: A predicted language needs at least this score; below it nothing can be told.
LEAST_LANGUAGE = 0.1


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents predicted toxic by a classifier fitted to all labels."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True)))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in which no language can be told: no text, no letter, or a score
    under ``LEAST_LANGUAGE``."""
    return langid.clean(docs, langid.train_profiles(docs), LEAST_LANGUAGE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of texts that are similar by 0.8 or
    more in five-word shingles."""
    return simhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item within its edit budget."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.pack(docs, word_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pack", pack),
]

#: SQL cannot express the fitted classifier, so tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
