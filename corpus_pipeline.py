"""The corpus pipeline: what documents become training data, stage by stage.

Every stage takes an empty table and gives an empty one, keeps all columns, takes columns named like
its own ones, and treats rows that repeat alike, unless it says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from changerisk.llm.decontamination import decontaminate
from changerisk.llm.language import keep_identified
from changerisk.llm.mixing import mixed_rows
from changerisk.llm.neardup import keep_one
from changerisk.llm.quality import keep_good
from changerisk.llm.shared import ship_code, stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which some language is recognised; null, empty and letterless texts go."""
    ship_code(spark)
    return keep_identified(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by importance for good text.

    Null and empty texts have importance 0. Without good or without bad labels among the documents all stay.
    """
    ship_code(spark)
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one of the least id, of rows that repeat it any one.

    Texts without words, null ones too, are no copies of each other and all stay.
    """
    ship_code(spark)
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages, and n_chars of what is left; documents that are mostly such passages go.

    Null and empty texts stay, and null and empty items match nothing.
    """
    ship_code(spark)
    clean = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix of sources takes, with how often.

    A null source is a source. Null and blank texts have size 0: they are taken where their key is, for no words.
    """
    ship_code(spark)
    return mixed_rows(docs)


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The language and quality stages are models that SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to all documents; each one's result is stored before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
