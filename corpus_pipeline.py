"""From raw documents to packed sequences in five stages.

Each stage works on all that its predecessor kept.  Between stages the documents
are written as Parquet to the shared folder named by ``spark.checkpoint.dir``, so
a lost executor costs no more than the stage it was lost in.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from paceforge.llm import language_id, minhash, mixing, packing, quality_classifier
from paceforge.llm.common import shared_folder, table


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; others go."""
    return language_id.keep_identified(docs, language_id.train(docs))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good."""
    return quality_classifier.keep_good(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id.

    Near is a similarity of 0.8 or more; at exactly 0.8 a pair lacks a common band
    among twenty with probability 3e-5.
    """
    return minhash.keep_one_of_each(docs, percent=80, bands=20)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at the sources' target weights; those of scarce sources may come more than once."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths, each a sequence."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_languages),
    ("quality_classifier", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


#: Language, quality and token ids can't be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL = None
